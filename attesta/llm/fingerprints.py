"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a boundary is set where its top bits are zero.
Chunking is normalised: below the normal size more bits must be zero than above it, so sizes gather
around the normal size. Boundaries depend on the bytes near them only, so an insertion or deletion
changes the chunks around it and no others. A fingerprint is the set of chunk digests with their
lengths; the containment of one text in another is the length-weighted share of its chunks that the
other has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm._arrow import SLICE_BYTES, text_slices, word_hashes

LEAST, NORMAL, MOST = 24, 64, 256  # bytes in a chunk; LEAST is at least the window of 16, so no hash reaches over the start of a text
_STRICT, _EASY = np.uint32(0xFE000000), np.uint32(0xF8000000)
_GEAR = np.random.default_rng(0x6EA2).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear values of the last 16 bytes, each shifted by its distance (mod 2**32)."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
    return h


def cuts(strict: list[int], easy: list[int], offsets: list[int]) -> tuple[list[int], list[int]]:
    """Ends of all chunks, and for each text the number of chunks up to its end."""
    strict, easy = [*strict, 1 << 62], [*easy, 1 << 62]
    out, upto, i, j = [], [], 0, 0
    for start, end in zip(offsets[:-1], offsets[1:]):
        while start < end:
            low, mid = start + LEAST, start + NORMAL
            while strict[i] + 1 < low:
                i += 1
            cut = strict[i] + 1
            if cut >= mid:
                while easy[j] + 1 < mid:
                    j += 1
                cut = min(easy[j] + 1, start + MOST)
            start = cut if cut < end else end
            out.append(start)
        upto.append(len(out))
    return out, upto


def fingerprints(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the ascending distinct values (48 bits of digest, 16 bits of length); none for null and empty texts."""
    for _, _, data, offsets in text_slices(column):
        if not len(data):
            yield from (np.zeros(0, np.uint64) for _ in range(len(offsets) - 1))
            continue
        h = gear(data)
        ends, upto = cuts(np.flatnonzero((h & _STRICT) == 0).tolist(), np.flatnonzero((h & _EASY) == 0).tolist(), offsets.tolist())
        ends = np.array(ends, np.int64)
        starts = np.r_[0, ends[:-1]]
        value = (word_hashes(data, starts, ends, lower=False) & np.uint64(0xFFFFFFFFFFFF0000)) | (ends - starts).astype(np.uint64)
        first = 0
        for last in upto:
            yield np.unique(value[first:last])
            first = last


def containment(x: np.ndarray, y: np.ndarray) -> float:
    """Length-weighted share of x's chunks that y has; two empty texts are alike (1), an empty and another are not (0)."""
    if not len(x):
        return float(not len(y))
    if not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    weight = (x & np.uint64(0xFFFF)).astype(np.int64)
    return float(weight[y[at] == x].sum() / weight.sum())


def as_text(fingerprint: np.ndarray) -> str:
    """16 hexadecimal digits for each chunk: digest, then length."""
    return fingerprint.astype(">u8").tobytes().hex()


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row, without a shuffle; a null or empty text has the empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(f) for f in fingerprints(batch.column(1))], pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, trailer, doc_id, text) in order -> a row for each document that has a follower in its bucket."""
    held: tuple | None = None  # bucket, id, text, fingerprint of the row whose follower is awaited
    done = None  # the bucket whose trailer was used
    for batch in batches:
        lo = 0
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(3)])
        while lo < batch.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), SLICE_BYTES, "right")))
            cut = batch.slice(lo, hi - lo)
            lo = hi
            texts = [t or "" for t in cut.column(3).to_pylist()]
            prints = fingerprints(cut.column(3))
            waits = []  # (id, text, fingerprint, edited text, fingerprint of the next)
            for bucket, trailer, doc_id, text, own in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), cut.column(2).to_pylist(), texts, prints):
                if held is not None and held[0] == bucket and not (trailer and done == bucket):
                    half = len(held[2]) // 2
                    waits.append((held[1], held[2], held[3], held[2][: len(held[2]) - half] + text[:half], own))
                if trailer:
                    done, held = bucket, None
                else:
                    held = (bucket, doc_id, text, own)
            edited = pa.array([w[3] for w in waits], pa.string())
            rows = [
                (w[0], len(w[1]), hashlib.sha256(w[3].encode()).hexdigest(), as_text(w[2]), as_text(e), containment(w[2], e), containment(w[2], w[4]))
                for w, e in zip(waits, fingerprints(edited))
            ]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The next document is the one that follows in ascending doc_id (null ids first; rows of one id in
    the order of their texts); after the last comes the first, and a single document follows itself.
    The edited text has the last floor(n / 2) code points replaced by the first as many of the next
    text. Null texts are empty. Other columns are not read. An empty table gives an empty table.

    Ids are cut into buckets at their quantiles; the first document of a bucket also goes to the
    bucket before as its trailer. So one shuffle of the texts is enough and no bucket needs another.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = texts.select("doc_id")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = ids.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] or []
    bounds = np.unique(np.array(cut, np.int64))  # as many as there are buckets at most

    @F.pandas_udf("int")
    def bucket_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        return pd.Series(np.where(known, np.searchsorted(bounds, doc_id.fillna(0).to_numpy(np.int64), "left"), -1).astype(np.int32))

    firsts = ids.groupBy(bucket_of("doc_id").alias("bucket")).agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()  # one row for each bucket
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {r["bucket"]: firsts[k - 1]["bucket"] for k, r in enumerate(firsts)}
    trails = spark.createDataFrame([(r["bucket"], before[r["bucket"]], r["first"]) for r in firsts], "bucket int, previous int, first long")
    placed = texts.withColumn("bucket", bucket_of("doc_id")).join(F.broadcast(trails), "bucket")
    both = placed.select(
        F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(F.struct(F.col("bucket"), F.lit(False).alias("trailer")), F.struct(F.col("previous").alias("bucket"), F.lit(True).alias("trailer")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("trailer"))))).alias("at"),
        "doc_id", "text",
    )
    rows = both.select("at.bucket", "at.trailer", "doc_id", "text")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "trailer", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
