from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import masked_lm as M
from attesta.llm._arrow import text_slices, word_hashes, words


def some(rng, n):
    return rng.integers(0, M.VOCAB + 1, (n, 2 * M.WINDOW)), rng.integers(0, M.VOCAB, n)


def test_conditionals_sum_to_one():
    rng = np.random.default_rng(0)
    net = M.Network.fresh(rng.integers(0, 1000, M.VOCAB))
    context = some(rng, 1)[0]
    assert np.exp(net.log_probabilities(np.repeat(context, M.VOCAB, 0), np.arange(M.VOCAB))).sum() == pytest.approx(1, abs=1e-3)


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    net = M.Network.fresh(rng.integers(0, 1000, M.VOCAB))
    context, target = some(rng, 6)
    g = net.gradient(context, target)
    for name in M._SHAPES:
        inside = M.Network(np.arange(M._SIZE).astype(np.float64)).__dict__[name].astype(int).ravel()
        for k in inside[np.argsort(-np.abs(g[inside]))[:3]]:
            flat, loss = net.flat.astype(np.float64), []
            for d in (1e-4, -1e-4):
                moved = flat.copy()
                moved[k] += d
                loss.append(-M.Network(moved).log_probabilities(context, target).mean())
            assert g[k] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=2e-2, abs=1e-4), name


def test_contexts_leave_the_token_and_other_texts_out():
    ids, first = np.array([1, 2, 3, 4, 5]), np.array([0, 3, 3, 5])
    got = M.contexts(ids, first, np.arange(5)).tolist()
    p = M.PAD
    assert got == [[p, p, 2, 3], [p, 1, 3, p], [1, 2, p, p], [p, p, 5, p], [p, 4, p, p]]


def test_vocabulary_counts_all_words(spark, documents):
    vocabulary, counts, every = M.count_vocabulary(documents)
    total = sum(len(r.text.split()) for r in documents.collect())
    assert counts.sum() == pytest.approx(total, rel=0.001) and (np.diff(counts) <= 0).all()
    assert every.agg(F.sum("n")).first()[0] == counts.sum() and vocabulary.distinct.sum() + len(vocabulary.frequent) == every.count()


def tokens(vocabulary, text):
    for _, _, data, offsets in text_slices(pa.array([text])):
        starts, stops, _ = words(data, offsets)
        hashes = word_hashes(data, starts, stops)
        return hashes, vocabulary.ids(hashes)[0].astype(np.int64)


def test_scores_follow_the_language(spark):
    """With the training of the registered query."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vocabulary, counts, _ = M.count_vocabulary(docs)
    given = docs.select(F.col("doc_id").alias("row"), "doc_id", "text")
    net = M.fit(given.mapInArrow(M._encode(vocabulary), M._ENCODED), counts)
    rng, better, logs = np.random.default_rng(2), [], []
    for r in docs.limit(80).collect():
        ids = tokens(vocabulary, r.text)[1] if r.text else []
        if len(ids) > 50:
            mixed, at, first = rng.permutation(ids), np.arange(len(ids)), np.array([0, len(ids)])
            own = net.log_probabilities(M.contexts(ids, first, at), ids)
            better.append(own.sum() > net.log_probabilities(M.contexts(mixed, first, at), mixed).sum())
            logs.append((own - np.log(counts[ids] / counts.sum())).mean())
    assert np.mean(better) > 0.8
    assert np.mean(logs) > 0.1  # both sides tell something


def test_against_a_loop_over_positions(spark, monkeypatch):
    """Each position alone, with full softmax sums, and shares counted over the texts themselves."""
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 40))) + (f" only{k}" if k % 2 else "") for k in range(12)] + ["", None]
    texts += [texts[1]]
    kept = []
    fit = M.fit
    monkeypatch.setattr(M, "WORDS", 30)
    monkeypatch.setattr(M, "BUCKETS", M.VOCAB - 30)
    monkeypatch.setattr(M, "fit", lambda *a: kept.append(fit(*a)) or kept[-1])
    seen = M.count_vocabulary
    monkeypatch.setattr(M, "count_vocabulary", lambda d: kept.append(seen(d)) or kept[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in M.pseudo_likelihood(docs).collect()}
    (vocabulary, _, _), net = kept
    split = [(t or "").split() for t in texts]
    for i, own in enumerate(split):
        hashes, ids = tokens(vocabulary, " ".join(own)) or ([], [])
        total = 0.0
        for k, word in enumerate(own):
            h = net.shift.astype(float).copy()
            for j, d in enumerate([-2, -1, 1, 2]):
                h += net.embed[ids[k + d] if 0 <= k + d < len(own) else M.PAD] * net.scale[j]
            h = np.tanh(h)
            c, w = divmod(int(ids[k]), M.IN_CLASS)
            a, p = net.class_w @ h + net.class_b, net.word_w[c] @ h + net.word_b[c]
            total += a[c] - np.log(np.exp(a).sum()) + p[w] - np.log(np.exp(p).sum())
            if hashes[k] not in vocabulary.frequent:
                others = [x for j, t in enumerate(split) if j != i for x in t]
                same = [x for x in set(x for t in split for x in t) if (hx := tokens(vocabulary, x)[0][0]) not in vocabulary.frequent and vocabulary.bucket_of(np.array([hx]))[0] == vocabulary.bucket_of(hashes[k : k + 1])[0]]
                total += np.log((others.count(word) + M.ALPHA) / (sum(others.count(x) for x in same) + M.ALPHA * len(same)))
        assert got[i].pseudo_log_likelihood == pytest.approx(total, rel=1e-3, abs=1e-3) and got[i].n_tokens == len(own)
        assert got[i].n_unshared == sum(w not in {x for j, t in enumerate(split) if j != i for x in t} for w in own)
    assert got[1].pseudo_log_likelihood == pytest.approx(got[14].pseudo_log_likelihood, abs=1e-4)


def test_awkward_rows(spark, awkward):
    out = M.pseudo_likelihood(awkward).collect()
    assert len(out) == awkward.count()
    for r in out:
        assert (r.n_tokens == 0 and r.pseudo_log_likelihood == 0 and r.mean_log_probability is None) or (r.pseudo_log_likelihood < 0 and np.isfinite(r.pseudo_perplexity))
    assert M.pseudo_likelihood(awkward.limit(0)).count() == 0


def test_every_position_is_trained_once(spark, monkeypatch):
    """Over the rounds of the registered query."""
    from attesta.llm import queries as Q

    d, seen, fit = "/root/testdata/sf0.001", [], M.fit

    def spy(encoded, counts, rounds):
        form = "piece int, lane int, seen long, weights binary"
        flat = M.Network.fresh(counts).flat
        sent = [encoded.select("row", "ids").mapInArrow(M._train(flat, k, rounds, 4, 0.05, 8192, 3), form).where("piece = 0").agg(F.sum("seen")).first()[0] for k in range(rounds)]
        seen.append((sum(sent), int(counts.sum())))
        return fit(encoded, counts, rounds)

    monkeypatch.setattr(M, "fit", spy)
    out = Q.op2_masked_pseudo_likelihood(spark, d)
    assert out.where("n_tokens > 0").agg(F.max("pseudo_log_likelihood")).first()[0] < 0
    assert seen[0][0] == seen[0][1]


def test_steps_share_a_runs_layout(monkeypatch):
    """A run of texts is laid out once for all its steps; every step meets its positions' own neighbours, in any order."""
    rng, layouts, met = np.random.default_rng(6), [], []
    texts = [rng.integers(0, M.VOCAB, n) for n in (40, 0, 1, 2, 700)]
    ids, first = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    widened, around = M.widened, M.around
    monkeypatch.setattr(M, "widened", lambda *a: layouts.append(widened(*a)) or layouts[-1])
    monkeypatch.setattr(M, "around", lambda *a: met.append(around(*a)) or met[-1])
    monkeypatch.setattr(M.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([t.astype("<u2").tobytes() for t in texts], pa.binary())], names=["row", "ids"])
    net = M.Network.fresh(rng.integers(0, 1000, M.VOCAB))
    sent = list(M._train(net.flat, 0, 1, 4, 0.05, 50, 3)([batch]))
    assert sent[0].column(2)[0].as_py() == len(ids) and len(layouts) == 1 and len(met) == -(-len(ids) // 50)
    p = [M.PAD] * M.WINDOW
    want = [tuple(np.r_[p, t, p][[i, i + 1, i + 3, i + 4]]) for t in texts for i in range(len(t))]
    assert sorted(map(tuple, np.concatenate(met).tolist())) == sorted(want)
    mixed, context = rng.permutation(len(ids)), M.contexts(ids, first, np.arange(len(ids)))
    assert net.log_probabilities(context[mixed], ids[mixed]) == pytest.approx(net.log_probabilities(context, ids)[mixed], abs=1e-4)
