import random
import re
import sys
import textwrap
from fractions import Fraction
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from oracle import spark_rows, sql_rows

from attesta.llm import licenses as L
from attesta.llm import queries as Q


def test_query_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        got = spark_rows(Q.op8_license_dice(spark, d))
        assert got == sql_rows(d, Q.ORACLE_SQL["op8_license_dice"]) and any(r[-1] for r in got)


def brute(text, t):
    """(start, licence, shared, size) of every window, then the best of each run."""
    words, out = L.text_words(text or ""), []
    for name, template in L.TEMPLATES.items():
        own, w = set(L.bigrams(template)), len(L.text_words(template))
        size, runs = min(w, len(words)), []
        for s in range(len(words) - size + 1 if size > 1 else 0):
            a = set(L.bigrams(" ".join(words[s : s + size])))
            if Fraction(2 * len(a & own), len(a) + len(own)) >= t:
                hit = (-2 * len(a & own) / (len(a) + len(own)), s, len(a & own), len(a) + len(own))
                if runs and s - runs[-1][-1][1] < w:
                    runs[-1].append(hit)
                else:
                    runs.append([hit])
        out += [(s, name, shared, size) for _, s, shared, size in map(min, runs)]
    return sorted(out)


def found(df, t):
    hits = df.select("doc_id", L.text_bigrams(F.col("text")).alias("grams")).select("doc_id", L.licence_hits(F.col("grams"), threshold=t).alias("hits"))
    return {r.doc_id: [(h.start, h.license, h.shared, h["size"]) for h in r.hits] for r in hits.collect()}


def test_near_notices_against_brute_force(spark):
    rng, texts = random.Random(6), []
    for _ in range(250):
        words = re.findall(r"\S+", rng.choice(list(L.TEMPLATES.values())))
        for _ in range(rng.randrange(0, 4) + len(words) // 30):
            words[rng.randrange(len(words))] = rng.choice(["the", "foo", "License", "3.0", "under the"])
        text = rng.choice([" ", "  ", "\t", "\n * "]).join(words)
        texts.append(rng.choice([text, "Some line.\n" + text, text.upper() + "\nother words here", text + "\n" + rng.choice(texts or [""]), f"prefix {text} suffix", text + " " + text]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for t in ("0.8", "0.5"):
        assert found(df, t) == {k: brute(x, Fraction(t)) for k, x in enumerate(texts)}


def test_notices_in_lines_files_and_side_by_side(spark):
    wrapped = "\n".join(f"// {line}" for line in textwrap.wrap(L.TEMPLATES["MIT-text"], 70))
    code = "\n".join(f"int f{k}(int x) {{ return x + {k}; }}" for k in range(40))
    texts = [
        code + "\n" + wrapped + "\n" + code,
        "Copyright (c) 2024 Example Ltd. Released under the MIT License. All else is reserved.",
        L.TEMPLATES["MIT"] + "\n" + code + "\nThe pictures: " + L.TEMPLATES["CC-BY-NC-4.0"],
        code,
    ]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "0.8")
    assert [(n, s == z / 2) for _, n, s, z in got[0]] == [("MIT-text", True)]
    assert [n for _, n, _, _ in got[1]] == ["MIT"] and [n for _, n, _, _ in got[2]] == ["MIT", "CC-BY-NC-4.0"] and got[3] == []


def test_bounds():
    for t in (Fraction("0.8"), Fraction("0.5")):
        for b in range(1, 40):
            sizes = [s for s in range(1, 200) if Fraction(2 * min(s, b), s + b) >= t]
            assert (min(sizes), max(sizes)) == (L.least_size(b, t), L.most_size(b, t))


def test_awkward_rows(spark, awkward):
    out = L.scan_licenses(awkward).collect()
    assert len(out) == awkward.count() and all(r.n_hits == 0 and r.license is None and r.dice is None for r in out)
    assert L.scan_licenses(awkward.limit(0)).count() == 0
    assert L.scan_licenses(awkward, {"none": "word"}).where("n_hits > 0").isEmpty()
