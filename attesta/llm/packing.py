"""Concatenate and cut: documents as one stream of tokens, cut into fixed windows.

Two passes. The first encodes the documents and writes their ids with running totals inside each
partition; prefix sums over the partitions' totals (one number each) then place every partition in
the stream. The second pass is arithmetic on each row: a document that lies across a window's edge
gives one boundary record for each window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attesta.llm.tokenize import default_path, offsets_by_part, token_table
from attesta.session import materialise

#: Partition totals are sent to all executors up to this many (24 bytes each); beyond it they are joined by a shuffle.
BROADCAST_PARTS = 100_000


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, padded_length.

    Each id of each document, its end id included, lies in exactly one piece. All sequences but the
    last are full; the last is padded to ``window`` unless its length is a power of two. Null texts
    are empty and give the end id alone; null and repeated ids are packed like others; an empty
    table gives no pieces. Other columns are not read.
    """
    tokens = materialise(token_table(docs, tokenizer_path or default_path(), end_id, id_col, text_col), "pack-tokens")
    totals = materialise(offsets_by_part(tokens.groupBy("part").agg(F.sum("n").alias("tokens"))), "pack-offsets")
    placed = tokens.join(F.broadcast(totals) if totals.count() <= BROADCAST_PARTS else totals, "part")
    at = placed.selectExpr("doc_id", "n", "ids", "total", "base + local_start as g").select(
        "*", F.explode(F.expr(f"sequence(g div {window}, (g + n - 1) div {window})")).alias("sequence_id")
    )
    cut = at.selectExpr(
        "doc_id", "n", "ids", "sequence_id", "g",
        f"greatest(g, sequence_id * {window}) as lo", f"least(g + n, (sequence_id + 1) * {window}) as hi",
        f"least(total - sequence_id * {window}, {window}) as filled",
    )
    return cut.selectExpr(
        f"doc_id as {id_col}", "lo - g as start", "hi - lo as length", "substring(ids, cast(4 * (lo - g) + 1 as int), cast(4 * (hi - lo) as int)) as ids",
        "n as doc_tokens", "sequence_id", f"lo - sequence_id * {window} as offset",
        f"case when (filled & (filled - 1)) = 0 then filled else {window} end as padded_length",
    )
