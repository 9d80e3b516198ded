import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa

from attesta.llm import ngram_jaccard as J


def brute(docs, n=3, num=90):
    sets = {}
    for i, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in ids}


def rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def family(rng, n_bases=12):
    """Bases with drifting copies: chains whose ends are not linked, equal sets, tiny texts."""
    out, i = [], 0
    vocabulary = [f"w{k}" for k in range(400)]
    for base in range(n_bases):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 40, 120, 300]))]
        for _ in range(rng.randrange(1, 14)):
            out.append((i, (" " if rng.random() < 0.5 else "\n").join(w.upper() if rng.random() < 0.1 else w for w in text)))
            i += 1
            text = list(text)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rng.shuffle(out)
    return out


def test_against_brute_force(spark):
    for seed in range(2):
        docs = family(random.Random(seed))
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert rows(J.jaccard_classes(df, block=7)) == brute(docs)
    assert rows(J.jaccard_classes(df, n=2, threshold="0.8")) == brute(docs, 2, 80)


def test_whole_table_against_brute_force(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert rows(J.jaccard_classes(documents)) == brute(docs)


def test_divide_skip_finds_all():
    rng = np.random.default_rng(5)
    for t in (Fraction("0.5"), Fraction("0.8"), Fraction("0.9")):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 8), dtype=np.uint64)]) for _ in range(80)]
        index = J.InvertedIndex(sets)
        for q in sets[:30]:
            want = [k for k, s in enumerate(sets) if len(np.intersect1d(q, s)) >= t * len(np.union1d(q, s))]
            assert sorted(index.search(q, t)) == want


def test_signatures_shared_at_threshold():
    rng = np.random.default_rng(9)
    for t in (Fraction("0.9"), Fraction("0.8")):
        bands = J.Bands(t)
        for size in [1, 2, 4, 5, 9, 10, 19, 20, 40, 77, 200, 1000]:
            for _ in range(30):
                x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
                y = np.sort(rng.choice(x, len(x) - rng.integers(0, len(x) // 4 + 1), replace=False))
                y = np.unique(np.r_[y, rng.integers(0, 1 << 63, rng.integers(0, len(x) // 8 + 1), dtype=np.uint64)])
                if len(np.intersect1d(x, y)) >= t * len(np.union1d(x, y)):
                    pairs = [(max(a, b), len(np.intersect1d(p, q))) for a, p in J.signatures(x, bands) for b, q in J.signatures(y, bands)]
                    assert any(n >= least for least, n in pairs)


def test_shingle_hash_is_of_words():
    a = list(J.shingle_sets(pa.array(["A b\tc d", "a B c  d", "a b", "ab", None, ""]), 3))
    assert np.array_equal(a[0], a[1]) and len(a[0]) == 2 and len(a[2]) == 1 and a[2][0] != a[3][0] and len(a[4]) == len(a[5]) == 0


def test_awkward_rows(spark, awkward):
    out = J.jaccard_classes(awkward).collect()
    assert len(out) == awkward.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None}
    assert got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (1, 5) and got[7][1] == 6
    assert [r.component_id for r in out if r.doc_id is None] == [None, None]
    kept = J.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 8] and kept.where("doc_id is null").count() == 2
    assert J.keep_one(awkward.limit(0)).count() == 0
    assert J.jaccard_classes(awkward.limit(0)).count() == 0


def test_keep_one_keeps_every_distinct_text(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a, "x", 1), (5, a, "y", 2), (5, b, "z", 3), (None, b, "w", 4), (None, a + " more", "v", 5), (7, None, "u", 6), (7, None, "u", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, `n.a me` long")
    kept = J.keep_one(docs, n=5, threshold="0.8")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[3]) == [rows[0], rows[2], rows[5], rows[6]]
    plain = spark.createDataFrame([(1, a), (2, b), (3, b + " more")], "doc_id long, text string")
    assert sorted(r.doc_id for r in J.keep_one(plain, n=5, threshold="0.8").collect()) == [1, 2]


def test_blocks_are_bounded_by_members(spark, monkeypatch):
    docs = family(random.Random(7), 8)
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 300)
    assert rows(J.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), n=2, threshold="0.8")) == brute(docs, 2, 80)
