import numpy as np
import pyarrow as pa

from attesta.llm import quality_fm as Q


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    machine = Q.Machine()
    machine.w = rng.normal(size=Q.N_FEATURES).astype(np.float32)
    machine.v = rng.normal(size=(Q.N_FEATURES, Q.FACTORS)).astype(np.float32)
    rows = [(rng.choice(Q.N_FEATURES, n, replace=False), rng.normal(size=n).astype(np.float32)) for n in (1, 2, 7, 30)]
    want = []
    for ids, x in rows:
        pairs = sum(float(machine.v[i] @ machine.v[j]) * x[a] * x[b] for a, i in enumerate(ids) for b, j in enumerate(ids) if a < b)
        want.append(1 / (1 + np.exp(-(machine.w0 + machine.w[ids] @ x + pairs))))
    assert np.allclose(machine.scores(rows), want, atol=1e-4)


def test_features_of_odd_texts():
    got = list(Q.features(pa.array(["", None, "WORD word", "a " * 50000]), pa.array([0, None, 9, 100000], pa.int64())))
    assert len(got) == 4 and len(got[0][0]) == Q._STATS and len(got[2][0]) == Q._STATS + 1
    assert all(np.isfinite(v).all() and i.max() < Q.N_FEATURES for i, v in got)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality(docs, labels, max_train=1500).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_labels_held_out_change_nothing(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(documents, labels), Q.train(documents, flipped)
    assert a.w0 == b.w0 and np.array_equal(a.w, b.w)


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (6, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    out = Q.quality(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out is False for r in out if r.doc_id is None)
    assert Q.quality(awkward.limit(0), labels).count() == 0 and Q.quality(awkward, labels.limit(0)).count() == len(out)
    kept = Q.keep_good(awkward, labels, least=0.0)
    assert kept.columns == awkward.columns and kept.count() == len(out)


def test_training_rows_are_bounded_whatever_repeats(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("1L as doc_id", "concat('text ', id) as text", "9L as n_chars")
    seen = []
    fit = Q.Machine.fit
    monkeypatch.setattr(Q.Machine, "fit", lambda self, rows, labels: seen.append(len(rows)) or fit(self, rows, labels))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    Q.train(docs.union(spark.createDataFrame([(2, "x", 1)], docs.schema)), labels, max_train=2)
    assert seen[0] <= 2
