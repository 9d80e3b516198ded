"""Document quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2])

The bracket is the sum-of-squares identity: all pairwise interactions in time linear in the number
of features of a document. Words are hashed into ``2**WORD_BITS`` buckets, with the logarithm of
their counts scaled to length 1; each structure statistic is a one-hot bin.

Training uses at most ``max_train`` labelled rows, those first in the order of a seeded hash of the
id (the bound keeps training on the driver small; it does not depend on the size of the corpus).
Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm._arrow import mix, text_slices, word_hashes, words

WORD_BITS = 16
FACTORS = 8
_EDGES = np.array([1e-9, 0.001, 0.004, 0.015, 0.03, 0.06, 0.12, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])
_BINS = 16
#: Classes of bytes whose share of a text is a statistic.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b".,;:", b"!?", b"#$%&*@^~", b"()[]{}<>", b"'\"`", b"/\\|_=+-", bytes(range(128, 256))]
_STATS = len(_CLASSES) + 8
N_FEATURES = (1 << WORD_BITS) + _STATS * _BINS
_class_of = np.full(256, len(_CLASSES), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _class_of[np.frombuffer(_c, np.uint8)] = _k


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(x + 1.0), _BINS - 1).astype(np.int64)


def features(text: pa.Array, n_chars: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, values) of each row; a null or empty text has structure features only."""
    stat_value = np.float32(1 / np.sqrt(_STATS))
    base = (1 << WORD_BITS) + np.arange(_STATS) * _BINS
    chars = np.array([-1 if c is None else c for c in n_chars.to_pylist()], np.float64)
    for lo, hi, data, offsets in text_slices(text):
        starts, stops, first = words(data, offsets)
        hashes = word_hashes(data, starts, stops)
        bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        size = np.maximum(np.diff(offsets), 1)
        n_words = np.diff(first)
        kind = _class_of[data]
        docs = hi - lo
        owner = np.repeat(np.arange(docs), np.diff(offsets))
        counts = np.bincount(owner * (len(_CLASSES) + 1) + kind, minlength=docs * (len(_CLASSES) + 1)).reshape(docs, -1)[:, : len(_CLASSES)]
        bins = np.zeros((docs, _STATS), np.int64)
        bins[:, : len(_CLASSES)] = np.searchsorted(_EDGES, counts / size[:, None], "right")
        c = len(_CLASSES)
        bins[:, c] = _log_bin(n_words)
        bins[:, c + 1] = _log_bin(counts[:, 4])
        word_owner = np.repeat(np.arange(docs), n_words)
        lengths = np.bincount(word_owner, stops - starts, docs) / np.maximum(n_words, 1)
        bins[:, c + 2] = np.minimum(lengths, _BINS - 1).astype(np.int64)
        # words that end in a mark other than a comma or full stop, words all in capitals
        tail = _class_of[data[stops - 1]] if len(stops) else np.zeros(0, np.uint8)
        bins[:, c + 3] = np.searchsorted(_EDGES, np.bincount(word_owner, (tail >= 6) & (tail <= 10), docs) / np.maximum(n_words, 1), "right")
        head = _class_of[data[starts]] if len(starts) else np.zeros(0, np.uint8)
        bins[:, c + 4] = np.searchsorted(_EDGES, np.bincount(word_owner, head == 0, docs) / np.maximum(n_words, 1), "right")
        known = chars[lo:hi]
        bins[:, c + 7] = np.where(known < 0, _BINS - 1, np.minimum(_log_bin(np.maximum(known, 0)), _BINS - 2))
        pair = mix(hashes[:-1] + np.uint64(3) * hashes[1:]) if len(hashes) > 1 else hashes[:0]
        for d in range(docs):
            a, b = int(first[d]), int(first[d + 1])
            ids, tf = np.unique(bucket[a:b], return_counts=True)
            n = b - a
            bins[d, c + 5] = np.searchsorted(_EDGES, len(ids) / n, "right") if n else _BINS - 1
            bins[d, c + 6] = np.searchsorted(_EDGES, len(np.unique(pair[a : b - 1])) / (n - 1), "right") if n > 1 else _BINS - 1
            value = np.log1p(tf)
            value /= np.sqrt(np.dot(value, value)) if n else 1
            yield np.r_[ids, base + bins[d]], np.r_[value.astype(np.float32), np.full(_STATS, stat_value)]


class Machine:
    """A factorisation machine, trained by AdaGrad on the logistic loss."""

    def __init__(self, seed: int = 7):
        self.w0 = 0.0
        self.w = np.zeros(N_FEATURES, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (N_FEATURES, FACTORS)).astype(np.float32)

    def margin(self, ids: np.ndarray, values: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins of rows that begin at ``heads``; also the per-feature products and per-row sums that the gradient needs."""
        vx = self.v[ids] * values[:, None]
        sums = np.add.reduceat(vx, heads, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), heads)
        return self.w0 + np.add.reduceat(self.w[ids] * values, heads) + 0.5 * ((sums * sums).sum(1) - squares), vx, sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 2e-5, seed: int = 11) -> Machine:
        rng, g0 = np.random.default_rng(seed), 1e-6
        gw, gv = np.full(N_FEATURES, 1e-6, np.float32), np.full((N_FEATURES, FACTORS), 1e-6, np.float32)
        for _ in range(epochs if len(rows) else 0):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                ids, values = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                n = np.array([len(rows[i][0]) for i in pick])
                y, vx, sums = self.margin(ids, values, np.cumsum(n) - n)
                error = ((1 / (1 + np.exp(-y)) - labels[pick]) / len(pick)).astype(np.float32)
                each = np.repeat(error, n)
                touched, where = np.unique(ids, return_inverse=True)
                dw = np.bincount(where, each * values, len(touched)).astype(np.float32) + decay * self.w[touched]
                dv = (each * values)[:, None] * (np.repeat(sums, n, axis=0) - vx)
                dv = np.stack([np.bincount(where, dv[:, f], len(touched)) for f in range(FACTORS)], 1).astype(np.float32) + decay * self.v[touched]
                g0 += float(error.sum()) ** 2
                self.w0 -= rate * float(error.sum()) / np.sqrt(g0)
                gw[touched] += dw * dw
                gv[touched] += dv * dv
                self.w[touched] -= rate * dw / np.sqrt(gw[touched])
                self.v[touched] -= rate * dv / np.sqrt(gv[touched])
        return self

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        n = np.array([len(r[0]) for r in rows])
        y = self.margin(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(n) - n)[0]
        return 1 / (1 + np.exp(-y.astype(np.float64)))


def held_out(doc_id: Column) -> Column:
    """True for rows kept from training: crc32 of the id as text leaves remainder 1 by 3 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(features(batch.column(1), batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([r[0].tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float32()))], names=["doc_id", "label", "ids", "values"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 5000, label_col: str = "quality") -> Machine:
    """A machine trained on at most ``max_train`` labelled rows that are not held out.

    Rows with a null id or label are not used; of several labels for an id the smallest counts, of
    several documents the one with the smallest digest of its text. So at most ``max_train`` rows
    come to the driver, whatever repeats.
    Without labelled rows the machine scores 0.5 or thereabouts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("known_id")).agg(F.min(label_col).alias("label"))
    chosen = known.where(~held_out(F.col("known_id"))).orderBy(F.xxhash64(F.col("known_id"), F.lit(41)), "known_id").limit(max_train)
    texts = docs.select(F.col("doc_id").alias("known_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    sample = texts.join(F.broadcast(chosen), "known_id").select("known_id", F.col("label").cast("long").alias("label"), F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text", "n_chars").alias("doc"))
    sample = sample.groupBy("known_id", "label").agg(F.min("doc").alias("doc")).select("known_id", "doc.text", "doc.n_chars", "label")
    got = sample.mapInArrow(_features, "doc_id long, label long, ids array<long>, values array<float>").toPandas()  # at most max_train rows
    got = got.sort_values("doc_id", kind="stable")
    rows = [(np.asarray(i, np.int64), np.asarray(v, np.float32)) for i, v in zip(got["ids"], got["values"])]
    return Machine().fit(rows, got["label"].to_numpy(np.float32))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row, in 0 to 1; null and empty texts are scored by their structure."""
    w0, w, v = machine.w0, machine.w, machine.v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine.__new__(Machine)
        own.w0, own.w, own.v = w0, w, v
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                cut = batch.slice(lo, 250)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(own.scores(list(features(cut.column(1), cut.column(2)))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, max_train: int = 5000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) for every row of ``docs``.

    Repeated and null ids stay as they are, null and empty texts are scored by their structure, long
    texts whole; other columns are not read, whatever their names; an empty table gives an empty table.
    """
    scored = score(docs, train(docs, labels, max_train))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = 5000, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with score >= ``least``; columns as they came, whatever their names.

    Each row is scored with its own text: repeated and null ids are rows like others, null and empty
    texts are scored by their structure, long texts whole. An empty table gives an empty table.
    """
    machine = train(docs, labels, max_train)
    w0, w, v = machine.w0, machine.w, machine.v
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine.__new__(Machine)
        own.w0, own.w, own.v = w0, w, v
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                cut = batch.slice(lo, 250)
                yield cut.filter(pa.array(own.scores(list(features(cut.column(text_at), cut.column(chars_at)))) >= least))

    return docs.mapInArrow(run, docs.schema)
