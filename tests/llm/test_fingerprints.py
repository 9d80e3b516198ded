import hashlib
import random

import numpy as np
import pyarrow as pa

from attesta.llm import fingerprints as P


def slow_cuts(data):
    """Byte by byte."""
    def h(i):
        return sum(int(P._GEAR[data[i - j]]) << j for j in range(16) if i - j >= 0) & 0xFFFFFFFF

    out, start = [], 0
    while start < len(data):
        cut = min(start + P.MOST, len(data))
        for end in range(start + P.LEAST, cut):
            mask = P._STRICT if end < start + P.NORMAL else P._EASY
            if h(end - 1) & int(mask) == 0:
                cut = end
                break
        out.append(cut)
        start = cut
    return out


def test_boundaries_against_a_rolling_loop():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh éü\n") for _ in range(n)) for n in (0, 1, 23, 24, 25, 63, 64, 300, 3000)] + ["a" * 1000]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h = P.gear(data)
    ends, upto = P.cuts(np.flatnonzero((h & P._STRICT) == 0).tolist(), np.flatnonzero((h & P._EASY) == 0).tolist(), offsets.tolist())
    first = 0
    for k, last in enumerate(upto):
        assert [e - offsets[k] for e in ends[first:last]] == slow_cuts(raw[k])
        first = last


def test_shift_resistance():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(800))
    a, b, c = P.fingerprints(pa.array([text, "new start " + text[:2000] + " inserted " + text[2000:], text.upper()]))
    assert P.containment(a, b) > 0.9 and P.containment(a, c) < 0.05 and P.containment(a, a) == 1


def check(spark, rows, df):
    got = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.fingerprint))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    prints = list(P.fingerprints(pa.array([r[1] for r in rows], pa.string())))
    want = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        e = next(P.fingerprints(pa.array([edited])))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), P.as_text(prints[k]), P.as_text(e), P.containment(prints[k], e), P.containment(prints[k], prints[(k + 1) % len(rows)])))
    want.sort(key=lambda r: (r[0] is not None, r[0], r[3]))
    assert [tuple(r) for r in got] == want


def test_whole_table_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(spark, rows, P.compare_with_next(documents))
    check(spark, rows, P.compare_with_next(documents.repartition(7)))


def test_awkward_rows(spark, awkward):
    check(spark, [(r.doc_id, r.text) for r in awkward.collect()], P.compare_with_next(awkward))
    assert P.compare_with_next(awkward.limit(0)).count() == 0
    one = awkward.where("doc_id = 5").limit(1)
    check(spark, [(5, "word")], P.compare_with_next(one))
    assert P.fingerprint_table(awkward).count() == awkward.count()
