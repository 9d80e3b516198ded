import random
import sys
from fractions import Fraction
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from oracle import spark_rows, sql_rows

from attesta.llm import mixing as M
from attesta.llm import queries as Q


def test_query_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        assert spark_rows(Q.op5_hierarchical_budget(spark, d)) == sql_rows(d, Q.ORACLE_SQL["op5_hierarchical_budget"])


def fill(given, nodes):
    """Water-filling with exact fractions: {name: (weight, capacity)} -> {name: amount}."""
    out, open_ = {}, dict(nodes)
    while open_:
        level = Fraction(given - sum(out.values()), sum(w for w, _ in open_.values()))
        full = {k: c for k, (w, c) in open_.items() if c <= level * w}
        if not full:
            return out | {k: level * w for k, (w, _) in open_.items()}
        out |= full
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def test_allotments_are_water_filling(spark):
    rng = random.Random(4)
    for _ in range(4):
        nodes = {f"n{k}": (rng.randrange(1, 9), rng.randrange(0, 1000)) for k in range(12)}
        total = sum(c for _, c in nodes.values())
        given = rng.randrange(0, total + 1)
        df = spark.createDataFrame([(k, w, c, given) for k, (w, c) in nodes.items()], "name string, weight long, capacity long, given long")
        got = {r["name"]: r["allotted"] for r in M.allot(df, [], "name").collect()}
        want = fill(given, nodes)
        assert sum(got.values()) == given and all(abs(got[k] - want[k]) < 1 + 1e-9 for k in want)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10, 1), ("a", "x", "2", 1000, 1), ("a", "y", "3", 1000, 1), ("b", "x", "4", 1000, 1)], "domain string, lang string, source string, available long, rows long")
    got = {r.source: r.quota for r in M.quotas(leaves, {}, 13, 1).collect()}  # budget 391
    assert got["1"] == 10 and sum(got.values()) == 391 and abs(got["2"] - 88) <= 1 and abs(got["3"] - 98) <= 1 and abs(got["4"] - 195) <= 1


def test_prefix_text(spark):
    df = spark.createDataFrame([("  one two\tthree\n four ",), ("a b c d",)], "text string")
    got = [r[0] for r in df.select(M.token_prefix(F.col("text"), F.lit(2))).collect()]
    assert [g.split() for g in got] == [["one", "two"], ["a", "b"]] and all(t.startswith(g) for g, (t,) in zip(got, df.collect()))


def test_documents_of_one_epoch(spark, documents):
    rows = M.mix_rows(documents, Q.source_domain(), Q.MIX_WEIGHTS, 70, 1).collect()
    kept = M.mix_documents(documents, Q.source_domain(), Q.MIX_WEIGHTS, 70)
    assert kept.columns == documents.columns
    got = {r.doc_id: len((r.text or "").split()) for r in kept.collect()}
    assert {r.doc_id: r.taken for r in rows} == {k: v for k, v in got.items() if v}
    assert M.mix_documents(documents, Q.source_domain(), {}, 100).count() == documents.count()


def test_many_buckets(spark, documents, monkeypatch):
    want = sorted(M.mix_rows(documents, F.lit("d"), {}, 37, 2).collect())
    monkeypatch.setattr(M, "BUCKET_ROWS", 2)
    monkeypatch.setattr(M, "BROADCAST_LEAVES", 0)
    got = sorted(M.mix_rows(documents, F.lit("d"), {}, 37, 2).collect())
    assert got == want and sum(r.taken for r in got) == documents.select(F.sum(M.n_tokens(F.col("text")))).first()[0] * 37 // 100


def test_awkward_rows(spark, awkward):
    total = awkward.select(F.sum(M.n_tokens(F.col("text")))).first()[0]
    for percent in (1, 33, 100, 250):
        out = M.mix_rows(awkward, F.lit(None), {}, percent, 2).collect()
        assert sum(r.taken for r in out) == min(total * percent // 100, 2 * total) and all(r.domain == "(none)" for r in out)
    assert M.mix_documents(awkward, F.lit("x"), {}, 100).count() == awkward.count()
    assert M.mix_rows(awkward.limit(0), F.lit("x"), {}).count() == 0 and M.mix_documents(awkward.limit(0), F.lit("x"), {}).count() == 0
    twins = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 5, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.taken for r in M.mix_rows(twins, F.lit("x"), {}, 50, 1).collect()) == [1, 3, 3]
    assert sorted(r.text.strip() for r in M.mix_documents(twins, F.lit("x"), {}, 50).collect()) == ["a", "a b c", "a b c"]
