"""Token files coded by a static range asymmetric numeral system (rANS).

One table of frequencies, counted over all documents, is shared by all blocks. A block holds whole
documents and is coded on its own: its ids are dealt over interleaved lanes, each with a state of
its own, so numpy takes a step of all lanes at once. A block also holds checkpoints (all states and
the place in the stream after every so many steps), and checksums of the stream and of the ids.
Decoding starts at all checkpoints of a block at once: the lanes of all its intervals take a step
together, so a block takes as many steps as one interval, however long it is.

A token file is a Parquet dataset of blocks (one row: part, block, first token, payload) beside a
dataset of frequencies. Spark's commit protocol makes the write safe against lost executors, and
any store that Spark reads can hold it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm.tokenize import default_path, narrow_ids, offsets_by_part, token_table
from attesta.session import materialise, shared_dir

BITS = 20  # frequencies sum to 2**BITS
LOW = np.uint64(1 << 31)
LANES = 512
BLOCK_TOKENS = 1 << 18
CHECK_STEPS = 128
#: Words whose ids a worker keeps: about 100 bytes each. This query has the memory; stages of a pipeline keep fewer.
CACHE_WORDS = 600_000
_HEAD = struct.Struct("<4sHHIIIIIII")  # magic, version, lanes, tokens, documents, words, checkpoints, table crc, ids crc, stream crc
_W = np.uint64(32)
_B = np.uint64(BITS)


class Table:
    """Shared frequencies: ids (ascending) and their counts scaled to sum to 2**BITS, each at least 1."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(self.ids.tobytes() + self.freq.tobytes())
        self.place = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        self.place[ids] = np.arange(len(ids))
        self.slot = np.repeat(np.arange(len(ids), dtype=np.int32), self.freq.astype(np.int64))

    @staticmethod
    def scaled(ids: np.ndarray, counts: np.ndarray) -> Table:
        """Counts in proportion; what rounding leaves over goes to or comes from the most frequent ids."""
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order].astype(np.float64)
        total = 1 << BITS
        if len(ids) > total // 2:
            raise ValueError(f"{len(ids)} different ids are too many for {BITS} bits")
        freq = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
        left, by = total - int(freq.sum()), np.argsort(-freq, kind="stable")
        if left > 0:
            freq[by[0]] += left
        for i in by:
            if left >= 0:
                break
            take = min(-left, int(freq[i]) // 2)
            freq[i] -= take
            left += take
        return Table(ids, freq)


def encode_block(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, table: Table) -> bytes:
    """One block of whole documents."""
    n = len(ids)
    symbols = table.place[ids]
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    chunks, sizes, checks = [b""] * steps, np.zeros(steps, np.int64), []
    limit = ((LOW >> _B) << _W) * table.freq
    for t in range(steps - 1, -1, -1):
        s = symbols[t * LANES : (t + 1) * LANES]
        x, f = state[: len(s)], table.freq[s]
        full = x >= limit[s]
        if full.any():
            out = x[full]
            chunks[t] = out.astype("<u4").tobytes()
            sizes[t] = len(out)
            x[full] = out >> _W
        q = x // f
        state[: len(s)] = (q << _B) + (x - q * f) + table.start[s]
        if t % CHECK_STEPS == 0:
            checks.append(state.astype("<u8").tobytes())
    checks.reverse()
    before = np.cumsum(sizes) - sizes
    stream = b"".join(chunks)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    side = zlib.compress(known.tobytes() + names.tobytes() + lengths.astype("<u4").tobytes(), 1)
    head = _HEAD.pack(b"RANS", 1, LANES, n, len(doc_ids), len(stream) // 4, len(checks), table.crc, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(stream))
    places = before[::CHECK_STEPS].astype("<u8").tobytes()
    return b"".join([head, struct.pack("<I", len(side)), side, places, *checks, stream])


class Block:
    """A parsed block; ``decode`` gives its ids from any checkpoint on, ``decode_parallel`` all of them from all checkpoints."""

    def __init__(self, payload: bytes, table: Table):
        (magic, version, self.lanes, self.n, docs, self.words, checks, table_crc, self.crc, stream_crc) = _HEAD.unpack_from(payload)
        if magic != b"RANS" or version != 1:
            raise ValueError("not a block of this format")
        if table_crc != table.crc:
            raise ValueError("the block was coded with another table")
        at = _HEAD.size
        (size,) = struct.unpack_from("<I", payload, at)
        side = zlib.decompress(payload[at + 4 : at + 4 + size])
        at += 4 + size
        names = np.frombuffer(side, "<i8", docs, docs).tolist()
        self.doc_ids = [d if k else None for d, k in zip(names, side[:docs])]
        self.lengths = np.frombuffer(side, "<u4", docs, 9 * docs).astype(np.int64)
        self.places = np.frombuffer(payload, "<u8", checks, at)
        at += 8 * checks
        self.states = np.frombuffer(payload, "<u8", checks * self.lanes, at).reshape(checks, self.lanes)
        at += 8 * checks * self.lanes
        if len(payload) != at + 4 * self.words or zlib.crc32(payload[at:]) != stream_crc:
            raise ValueError("the block's stream is damaged")
        self.stream = np.frombuffer(payload, "<u4", self.words, at)
        self.table = table

    def decode(self, checkpoint: int = 0, checkpoints: int | None = None) -> np.ndarray:
        """Ids from ``checkpoint`` on, over ``checkpoints`` intervals (None: to the end, and checked against the checksum if from 0)."""
        t, lanes = self.table, self.lanes
        if not len(self.states):
            return np.zeros(0, np.uint32)
        first = checkpoint * CHECK_STEPS
        steps = -(-self.n // lanes)
        last = steps if checkpoints is None else min(steps, first + checkpoints * CHECK_STEPS)
        state, at = self.states[checkpoint].copy(), int(self.places[checkpoint])
        mask, out = np.uint64((1 << BITS) - 1), np.empty(min(self.n, last * lanes) - first * lanes, np.uint32)
        start = t.start
        for k in range(first, last):
            size = min(lanes, self.n - k * lanes)
            x = state[:size]
            slot = x & mask
            s = t.slot[slot]
            out[(k - first) * lanes : (k - first) * lanes + size] = t.ids[s]
            x = t.freq[s] * (x >> _B) + slot - start[s]
            need = np.flatnonzero(x < LOW)
            if len(need):
                x[need] = (x[need] << _W) | self.stream[at : at + len(need)]
                at += len(need)
            state[:size] = x
        if checkpoint == 0 and last == steps and zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("the block's ids are damaged")
        return out


    def decode_parallel(self) -> np.ndarray:
        """All ids, checked against the checksum: every interval but the last, which may be short, at the same time."""
        t, full = self.table, len(self.states) - 1
        if full < 1:
            return self.decode()
        state, at = self.states[:full].copy(), self.places[:full].astype(np.int64)
        mask, out = np.uint64((1 << BITS) - 1), np.empty((full, CHECK_STEPS, self.lanes), np.uint32)
        for k in range(CHECK_STEPS):
            slot = state & mask
            s = t.slot[slot]
            out[:, k] = t.ids[s]
            state = t.freq[s] * (state >> _B) + slot - t.start[s]
            row, lane = np.nonzero(state < LOW)  # by interval, then by lane, as the words lie in the stream
            taken = np.bincount(row, minlength=full)
            place = np.arange(len(row)) + (at - (np.cumsum(taken) - taken))[row]
            state[row, lane] = (state[row, lane] << _W) | self.stream[place]
            at += taken
        ids = np.concatenate([out.ravel(), self.decode(full)])
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.crc:
            raise ValueError("the block's ids are damaged")
        return ids


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            col = batch.column(0)
            for lo in range(0, len(col), 500):
                got = np.bincount(np.frombuffer(b"".join(col.slice(lo, 500).to_pylist()), f"<u{width}"), minlength=len(total))
                got[: len(total)] += total
                total = got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "count"])

    return run


def _encode(ids: np.ndarray, freq: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, block, total = Table(ids, freq), TaskContext.get().partitionId(), 0, 0
        names, held, size = [], [], 0

        def close():
            nonlocal block, total, names, held, size
            lengths = np.array([len(x) // width for x in held], np.int64)
            payload = encode_block(np.frombuffer(b"".join(held), f"<u{width}"), names, lengths, table)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([total], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["part", "block", "local_start", "n", "payload"])
            block, total, names, held, size = block + 1, total + size, [], [], 0
            return row

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                cut = batch.slice(lo, 500)
                for name, x in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist()):
                    names.append(name)
                    held.append(x)
                    size += len(x) // width
                    if size >= BLOCK_TOKENS:
                        yield close()
        if held:
            yield close()

    return run


def _decode(ids: np.ndarray, freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(ids, freq)
        for batch in batches:
            for first, payload in zip(batch.column(0), batch.column(1)):
                block = Block(payload.as_py(), table)
                raw = block.decode_parallel().astype("<u4").tobytes()
                ends = np.cumsum(block.lengths)
                starts = ends - block.lengths
                texts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(starts + first.as_py()), pa.array(block.lengths), pa.array(texts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write ``path``/blocks and ``path``/frequencies, documents in ascending order of id.

    Null ids come first, rows of one id by their ids' bytes; null texts are empty (the end id alone).
    An empty table gives an empty file. Memory: a block and the table of at most as many rows as the
    vocabulary; a document is never split, so one longer than a block makes a block of its own.
    """
    own = tokenizer_path or default_path()
    width = 2 if narrow_ids(own, end_id) else 4
    tokens = materialise(token_table(docs, own, end_id, id_col, text_col, width, CACHE_WORDS).select("doc_id", "ids"), "rans-tokens")
    counts = tokens.select("ids").mapInArrow(_count(width), "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    seen = counts.toPandas()  # as many rows as the vocabulary at most
    table = Table.scaled(seen["id"].to_numpy(np.int64), seen["count"].to_numpy(np.int64)) if len(seen) else Table(np.zeros(0, np.int64), np.zeros(0, np.int64))
    spark = docs.sparkSession
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(table.ids, table.freq)], "id long, freq long").coalesce(1).write.parquet(f"{path}/frequencies")
    ordered = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(_encode(table.ids.astype(np.int64), table.freq.astype(np.int64), width), "part int, block int, local_start long, n long, payload binary").write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, decoded block by block; damage raises an error."""
    table = spark.read.schema("id long, freq long").parquet(f"{path}/frequencies").orderBy("id").toPandas()  # vocabulary-sized
    blocks = spark.read.schema("part int, block int, local_start long, n long, payload binary").parquet(f"{path}/blocks")
    base = offsets_by_part(blocks.groupBy("part").agg(F.sum("n").alias("tokens")))
    placed = blocks.join(base, "part").selectExpr("base + local_start as first", "payload")
    return placed.mapInArrow(_decode(table["id"].to_numpy(np.int64), table["freq"].to_numpy(np.int64)), "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write token files to the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/attesta/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path)
