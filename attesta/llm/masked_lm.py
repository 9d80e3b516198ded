"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

The network sees the ``WINDOW`` tokens on either side of a position, never the token itself: their
embeddings, scaled by position, are added and squashed to a hidden vector, and a two-level softmax
(class of the token, token within its class) gives the token's conditional probability. Words
outside the most frequent ones share tokens (hash buckets); such a word's probability is its
bucket's times its share of the bucket, which is masked like the rest: it is counted over all other
documents, plus ``ALPHA``, so a word that only this document has is an unseen one. A document's
score is the sum of the logarithms over all its positions.

Everything is taken from the whole corpus, and what is taken grows with it:

* All words of all documents are counted, and every word's own count enters the scores of the
  documents that hold it, by a join on the word. Only the most frequent words and the buckets' sums
  (fixed numbers of both) go to every executor.
* Training is data-parallel: every partition trains the current network in numpy, each of its
  positions in exactly one of the rounds, and after each round the partitions' weights are averaged
  by their positions.
* Scoring covers every position of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from attesta.llm._arrow import text_slices, word_hashes, words
from attesta.session import materialise

WORDS, BUCKETS = 3072, 1024  # tokens of their own; hash buckets for the rest
VOCAB = WORDS + BUCKETS
CLASSES = 64
IN_CLASS = VOCAB // CLASSES
WINDOW = 2
DIM = 16
PAD = VOCAB
BATCH = 1 << 15
ALPHA = 0.1  # occurrences added to a word's count in other documents
_PIECE = 1 << 14  # floats in a row of sent weights
_SHAPES = {"embed": (VOCAB + 1, DIM), "scale": (2 * WINDOW, DIM), "shift": (DIM,), "class_w": (CLASSES, DIM), "class_b": (CLASSES,), "word_w": (CLASSES, IN_CLASS, DIM), "word_b": (CLASSES, IN_CLASS)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def _shifted(logits: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """``logits`` + ``bias`` less their largest, in place. Hidden values lie in -1 to 1, so the largest logit of a batch shifts all rows safely."""
    logits += bias
    logits -= logits.max()
    return logits


def _row_sums(powers: np.ndarray) -> np.ndarray:
    return np.maximum(powers @ np.ones(powers.shape[1], powers.dtype), np.float32(1e-30))


def _error(logits: np.ndarray, bias: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """(Softmax of each row of ``logits`` + ``bias``, less 1 at the ``right`` place) / ``n``, in place."""
    np.exp(_shifted(logits, bias), out=logits)
    logits *= (np.float32(1 / n) / _row_sums(logits))[:, None]
    logits[np.arange(len(right)), right] -= np.float32(1 / n)
    return logits


def _logs(logits: np.ndarray, bias: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Logarithm of each row's softmax at the ``right`` place."""
    own = _shifted(logits, bias)[np.arange(len(right)), right]
    return own - np.log(_row_sums(np.exp(logits, out=logits)))


class Network:
    """Weights as views of one flat float32 vector."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def fresh(counts: np.ndarray, seed: int = 5) -> Network:
        """Small random weights; biases are the logarithms of the corpus frequencies (tokens are numbered by class)."""
        net = Network(np.random.default_rng(seed).normal(0, 0.1, _SIZE).astype(np.float32))
        net.scale += 1
        share = np.log((counts + 1.0) / (counts + 1.0).sum()).reshape(CLASSES, IN_CLASS)
        net.class_b[:] = np.log(np.exp(share).sum(1))
        net.word_b[:] = share - net.class_b[:, None]
        return net

    def hidden(self, seen: list[np.ndarray]) -> np.ndarray:
        """Hidden vectors from the embeddings at each place of the window."""
        h = seen[0] * self.scale[0] + self.shift
        for j in range(1, 2 * WINDOW):
            h += seen[j] * self.scale[j]
        return np.tanh(h, out=h)

    @staticmethod
    def _by_class(target: np.ndarray):
        """An order of the positions in which classes lie one after another, and (class, first, end) of those met."""
        order = np.argsort(target.astype(np.uint16), kind="stable")
        ends = np.searchsorted(target[order], np.arange(CLASSES + 1) * IN_CLASS).tolist()
        return order, [(c, lo, hi) for c, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])) if lo < hi]

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, spans = self._by_class(target)
        classes, within = np.divmod(target[order], IN_CLASS)
        h = self.hidden([self.embed.take(context[:, j][order], axis=0) for j in range(2 * WINDOW)])
        logs = _logs(h @ self.class_w.T, self.class_b, classes)
        for c, lo, hi in spans:
            logs[lo:hi] += _logs(h[lo:hi] @ self.word_w[c].T, self.word_b[c], within[lo:hi])
        out = np.empty_like(logs)
        out[order] = np.maximum(logs, np.log(1e-30).astype(logs.dtype))
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability."""
        n = len(target)
        g = Network(np.zeros(_SIZE, np.float32))
        order, spans = self._by_class(target)
        classes, within = np.divmod(target[order], IN_CLASS)
        sides = [context[:, j][order] for j in range(2 * WINDOW)]
        seen = [self.embed.take(side, axis=0) for side in sides]
        h = self.hidden(seen)
        a = _error(h @ self.class_w.T, self.class_b, classes, n)
        one = np.ones(n, a.dtype)
        np.matmul(a.T, h, out=g.class_w)
        np.matmul(one, a, out=g.class_b)
        dh = a @ self.class_w
        for c, lo, hi in spans:
            part = h[lo:hi]
            q = _error(part @ self.word_w[c].T, self.word_b[c], within[lo:hi], n)
            np.matmul(q.T, part, out=g.word_w[c])
            np.matmul(one[: hi - lo], q, out=g.word_b[c])
            dh[lo:hi] += q @ self.word_w[c]
        h *= h
        dh *= np.subtract(1, h, out=h)
        g.shift[:] = one @ dh
        for j, side in enumerate(sides):
            g.scale[j] = np.einsum("ij,ij->j", dh, seen[j])
            order = np.argsort(side.astype(np.uint16), kind="stable")
            ids = side[order]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            g.embed[ids[first]] += np.add.reduceat(dh.take(order, axis=0), first, axis=0) * self.scale[j]
        return g.flat

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float) -> int:
        """AdaGrad over (context, target) batches in place; the number of positions seen."""
        seen, squares, step = 0, np.full(_SIZE, 1e-8, np.float32), np.empty(_SIZE, np.float32)
        for context, target in batches:
            g = self.gradient(context, target)
            np.multiply(g, g, out=step)
            squares += step
            np.sqrt(squares, out=step)
            np.divide(g, step, out=step)
            step *= np.float32(rate)
            self.flat -= step
            seen += len(target)
        return seen


def widened(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a run of texts with PAD around each text, and where each token lies there; ``first``: where each text begins, and the end."""
    place = np.arange(len(ids)) + WINDOW * np.repeat(np.arange(1, len(first)), np.diff(first))
    wide = np.full(len(ids) + WINDOW * len(first), PAD, np.int64)
    wide[place] = ids
    return wide, place


def around(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Neighbours of places of ``wide``, one column for each place of the window."""
    out = np.empty((2 * WINDOW, len(at)), np.int64)
    for j, d in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        np.take(wide, at + d, out=out[j], mode="clip")
    return out.T


def contexts(ids: np.ndarray, first: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Neighbours of the positions of a run of texts; ``first``: where each text begins, and the end. Outside a text there is PAD."""
    wide, place = widened(ids, first)
    return around(wide, place[positions])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in held])
        ids, where = np.unique(keys, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64))], names=["word", "n"])

    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            starts, stops, _ = words(data, offsets)
            held.append(np.unique(word_hashes(data, starts, stops), return_counts=True))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


class Vocabulary:
    """Word hashes of the frequent words and how tokens are numbered: by falling count, so that classes hold tokens of like counts.

    ``total`` and ``distinct`` are the occurrences and the number of the words in each bucket.
    """

    def __init__(self, frequent: np.ndarray, number: np.ndarray, bucket_number: np.ndarray, total: np.ndarray, distinct: np.ndarray):
        self.frequent, self.number, self.bucket_number, self.total, self.distinct = frequent, number, bucket_number, total, distinct

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words, and which of them are buckets."""
        out = self.bucket_number[self.bucket_of(hashes)]
        known = np.zeros(len(hashes), bool)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            known = self.frequent[at] == hashes
            out = np.where(known, self.number[at], out)
        return out.astype(np.uint16), ~known

    def bucket_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(20)) % np.uint64(len(self.total))).astype(np.int64)


def count_vocabulary(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """The vocabulary of all words of all texts, the counts of its tokens by number, and the table of all words (word, n)."""
    counts = materialise(docs.select(text_col).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS)
    frequent = top.toPandas()  # WORDS rows at most
    bucket = F.expr(f"pmod(shiftrightunsigned(word, 20), {BUCKETS})")
    rest = counts.join(F.broadcast(top.select("word")), "word", "left_anti").groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()  # BUCKETS rows at most
    in_bucket, distinct = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    in_bucket[rest["bucket"].to_numpy(np.int64)] = rest["n"].to_numpy(np.int64)
    distinct[rest["bucket"].to_numpy(np.int64)] = rest["words"].to_numpy(np.int64)
    hashes, own = frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    everything = np.r_[own, np.zeros(WORDS - len(own), np.int64), in_bucket]
    number = np.empty(VOCAB, np.int64)
    number[np.argsort(-everything, kind="stable")] = np.arange(VOCAB)
    order = np.argsort(hashes)
    totals = np.zeros(VOCAB, np.int64)
    totals[number] = everything
    return Vocabulary(hashes[order], number[: len(hashes)][order], number[WORDS:], in_bucket, distinct), totals, counts


_ENCODED = "row long, doc_id long, ids binary, rare binary, rare_n binary, shared double"


def _encode(vocabulary: Vocabulary):
    """Rows (row, doc_id, text) -> tokens, the distinct words in buckets with their counts, and minus the logarithms of the buckets' sums elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                starts, stops, first = words(data, offsets)
                hashes = word_hashes(data, starts, stops)
                tokens, rare = vocabulary.ids(hashes)
                raw = tokens.astype("<u2").tobytes()
                ids = [raw[2 * a : 2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                at = np.flatnonzero(rare)
                text = np.searchsorted(first, at, "right") - 1
                order = np.lexsort((hashes[at], text))
                text, word = text[order], hashes[at][order]
                head = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])][: len(word)])
                n = np.diff(np.r_[head, len(word)])
                text, word = text[head], word[head]
                # per text and bucket: occurrences elsewhere
                where, inverse = np.unique(text * len(vocabulary.total) + vocabulary.bucket_of(word), return_inverse=True)
                here = np.bincount(inverse, n, len(where))
                b = where % len(vocabulary.total)
                logs = here * np.log(vocabulary.total[b] - here + ALPHA * vocabulary.distinct[b])
                shared = -np.bincount(where // len(vocabulary.total), logs, hi - lo)
                cuts = np.searchsorted(text, np.arange(hi - lo + 1)).tolist()
                words_raw, n_raw = word.astype("<u8").tobytes(), n.astype("<u4").tobytes()
                spans = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array([words_raw[8 * x : 8 * y] for x, y in spans], pa.binary()), pa.array([n_raw[4 * x : 4 * y] for x, y in spans], pa.binary()), pa.array(shared)],
                    names=["row", "doc_id", "ids", "rare", "rare_n", "shared"],
                )

    return run


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, word, own) of the words in buckets."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            cut = batch.slice(lo, 1000)
            rare = cut.column(1).to_pylist()
            row = np.repeat(cut.column(0).to_numpy(), [len(r) // 8 for r in rare])
            own = np.frombuffer(b"".join(cut.column(2).to_pylist()), "<u4")
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.frombuffer(b"".join(rare), "<i8")), pa.array(own.astype(np.int32))], names=["row", "word", "own"])


def _runs(batches: Iterator[pa.RecordBatch], tokens: int = 1 << 18) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(numbers of the rows, tokens, where each row begins and the end) for runs of rows (row, ids); a longer text makes a run of its own."""
    for batch in batches:
        ids = batch.column(1).to_pylist()
        lo = 0
        while lo < len(ids):
            hi, size = lo, 0
            while hi < len(ids) and (hi == lo or size + len(ids[hi]) // 2 <= tokens):
                size += len(ids[hi]) // 2
                hi += 1
            yield batch.column(0).slice(lo, hi - lo), np.frombuffer(b"".join(ids[lo:hi]), "<u2").astype(np.int64), np.cumsum([0, *[len(x) // 2 for x in ids[lo:hi]]])
            lo = hi


def _train(flat: np.ndarray, turn: int, turns: int, lanes: int, rate: float, step: int, seed: int):
    """Trains on those positions of a partition whose turn it is; each has one of ``turns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        net = Network(flat.copy())

        def positions():
            for count, (_, ids, first) in enumerate(_runs(batches)):
                wide, place = widened(ids, first)
                rng = np.random.default_rng([seed, count])
                pick = np.flatnonzero(rng.integers(0, turns, len(ids)) == turn)
                rng.shuffle(pick)
                for lo in range(0, len(pick), step):
                    at = pick[lo : lo + step]
                    yield around(wide, place[at]), ids[at]

        seen = net.train(positions(), rate)
        if seen:
            pieces = [net.flat[k : k + _PIECE] for k in range(0, _SIZE, _PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([part % lanes] * len(pieces), pa.int32()), pa.array([seen] * len(pieces), pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "lane", "seen", "weights"])

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weighted mean of the rows of one piece."""
    seen = pdf["seen"].to_numpy(np.float64)
    total = np.zeros(len(pdf["weights"].iloc[0]) // 4, np.float64)
    for n, w in zip(seen, pdf["weights"]):
        total += n * np.frombuffer(w, np.float32)
    return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "lane": [int(pdf["lane"].iloc[0])], "seen": [int(seen.sum())], "weights": [(total / seen.sum()).astype(np.float32).tobytes()]})


def fit(encoded: DataFrame, counts: np.ndarray, rounds: int = 2, rate: float = 0.1, step: int = 8192, seed: int = 3) -> Network:
    """A network trained on all positions of ``encoded`` (row, ids), each in one of ``rounds`` rounds; the partitions' weights are averaged after each.

    Averaging has two levels, of about the root of the number of partitions each.
    """
    net = Network.fresh(counts)
    form = "piece int, lane int, seen long, weights binary"
    parts = encoded.select(F.spark_partition_id().alias("part")).distinct().count()
    lanes = max(1, int(np.sqrt(parts)))
    for k in range(rounds):
        sent = encoded.select("row", "ids").mapInArrow(_train(net.flat, k, rounds, lanes, rate / (k + 1), step, seed), form)
        mean = sent.groupBy("piece", "lane").applyInPandas(_average, form).groupBy("piece").applyInPandas(_average, form).toPandas()  # one model
        if len(mean):
            net = Network(np.frombuffer(b"".join(mean.sort_values("piece")["weights"]), np.float32).copy())
    return net


def _score(flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat)
        for rows, ids, first in _runs(batches):
            logs, (wide, place) = np.empty(len(ids), np.float64), widened(ids, first)
            for lo in range(0, len(ids), BATCH):
                logs[lo : lo + BATCH] = net.log_probabilities(around(wide, place[lo : lo + BATCH]), ids[lo : lo + BATCH])
            sums = np.r_[0, np.cumsum(logs)]
            yield pa.RecordBatch.from_arrays([rows, pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]])], names=["row", "n_tokens", "tokens_log"])

    return run


def pseudo_likelihood(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """doc_id, mean_log_probability, pseudo_log_likelihood, pseudo_perplexity, n_tokens, n_unshared of every row.

    ``n_unshared`` counts the tokens whose word no other row has (words among the most frequent are
    taken to be shared). Texts without words and null texts have no tokens: likelihood 0, mean and
    perplexity null. Texts of any length are scored whole, in runs of a bounded number of positions.
    Repeated and null ids are rows like others, and equal rows get equal scores (up to rounding);
    other columns are not read, whatever their names; an empty table gives an empty table.
    """
    vocabulary, counts, every_word = count_vocabulary(docs)
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    encoded = materialise(given.mapInArrow(_encode(vocabulary), _ENCODED), "lm-ids")
    net = fit(encoded, counts, rounds)
    scored = encoded.select("row", "ids").mapInArrow(_score(net.flat), "row long, n_tokens long, tokens_log double")
    # every word in a bucket meets its count
    flat = encoded.select("row", "rare", "rare_n").mapInArrow(_flat, "row long, word long, own int").join(every_word, "word")
    elsewhere = F.col("n") - F.col("own")
    share = flat.groupBy("row").agg(F.sum(F.col("own") * F.log(elsewhere + ALPHA)).alias("share"), F.sum(F.when(elsewhere == 0, F.col("own")).otherwise(0)).alias("n_unshared"))
    joined = encoded.select("row", "doc_id", "shared").join(scored, "row").join(share, "row", "left")
    total = F.col("tokens_log") + F.coalesce(F.col("shared") + F.col("share"), F.lit(0.0))
    out = joined.select("doc_id", "n_tokens", total.alias("pseudo_log_likelihood"), F.coalesce("n_unshared", F.lit(0)).cast("long").alias("n_unshared"))
    mean = F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens"))
    return out.select("doc_id", mean.alias("mean_log_probability"), "pseudo_log_likelihood", F.exp(-mean).alias("pseudo_perplexity"), "n_tokens", "n_unshared")
