"""Secret scans over an incremental ledger of blobs.

Every historical version of a path is a blob, named by the SHA-256 of its text. The ledger holds one
row for each (blob, rule version) that was ever scanned, findings or none. A scan content-addresses
all versions (narrow rows), takes from the ledger what is known, moves and scans only the texts of
unseen pairs, one copy each, appends them, and joins the findings back to every path that has the
blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from attesta.session import materialise, quoted, shared_dir

#: Bumped whenever a rule changes, so that old blobs are scanned anew.
RULES_VERSION = "1"
BASE_KINDS = ("assign", "access", "hex")
#: kind -> (pattern, group whose length counts, least length); in this order spans with one start are listed.
RULES = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
    "private_key": (re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----)?"), 0, 1),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), 0, 1),
    "forge_token": (re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
}
#: A match of assign holds one of these in some case; looking for them first is much faster than the pattern.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind in the order of ``RULES``; code points, end exclusive."""
    found = []
    low = text.lower()
    names = any(word in low for word in _NAMES)
    for rank, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        if kind == "assign" and not names:
            continue
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def cover_of(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The spans' union as disjoint (start, end)."""
    out: list[tuple[int, int]] = []
    for _, start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    part = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    seen: set[str] = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            cut = batch.slice(lo, 1000)
            # rows that repeat path and text come several times
            fresh = []
            for blob in cut.column(0).to_pylist():
                fresh.append(blob not in seen)
                seen.add(blob)
            if len(seen) > REMEMBERED:
                seen.clear()
            if not all(fresh):
                cut = cut.filter(pa.array(fresh))
            spans = [spans_of(t) if t else [] for t in cut.column(1).to_pylist()]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            covers = [[{"start": a, "end": b} for a, b in cover_of(s)] for s in spans]
            yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(rows, span), pa.array(covers, part)], names=["blob", "spans", "cover"])


#: Blobs that a task remembers having scanned.
REMEMBERED = 100_000
#: Parts into which the rows of a blob are dealt when findings are joined back, so that a text that very many paths share is not one task.
SALTS = 16


class BlobLedger:
    """A ledger kept as a Parquet dataset of (blob, spans, cover) at ``path``, one folder for each rule version; None: a new one in the shared folder."""

    SCHEMA = f"blob string, spans {_SPAN}, cover array<struct<start: bigint, end: bigint>>, rules string"

    def __init__(self, spark, path: str | None = None, rules: str = RULES_VERSION):
        self.spark, self.rules = spark, rules
        self.path = path or f"{shared_dir(spark)}/attesta/ledger-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        """Everything scanned so far; empty if nothing was."""
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def known(self) -> DataFrame:
        """One row per blob scanned with this ledger's rules (an interrupted and repeated run may have appended a blob twice); other rules' folders are not read."""
        return self.rows().where(F.col("rules") == self.rules).drop("rules").dropDuplicates(["blob"])

    def scan(self, versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Scan what is unseen, append it, and return (path, blob, spans, cover) for every row of ``versions``.

        Null texts are empty texts, null paths are paths like others, repeated rows each give a row;
        an empty table gives an empty one. Texts of any length are scanned whole. Other columns are
        not read, whatever their names. Of the paths of an unseen blob the smallest gives the text.
        """
        texts = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        addressed = texts.select("path", "blob")
        done = self.rows().where(F.col("rules") == self.rules).select("blob")
        unseen = addressed.groupBy("blob").agg(F.min("path").alias("at")).join(done, "blob", "left_anti").select(F.col("blob").alias("want"), "at")
        move = texts.join(unseen, (F.col("blob") == F.col("want")) & F.col("path").eqNullSafe(F.col("at"))).select("want", "text")
        found = move.mapInArrow(_scan, f"blob string, spans {_SPAN}, cover array<struct<start: bigint, end: bigint>>")
        found.withColumn("rules", F.lit(self.rules)).write.mode("append").partitionBy("rules").parquet(self.path)
        # every blob is known now; those without findings need no join
        hits = self.known().where(F.size("spans") > 0).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = addressed.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
        none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", _SPAN), ("cover", "array<struct<start: bigint, end: bigint>>"))]
        return salted.join(hits, ["blob", "salt"], "left").select(F.col("path").alias(path_col), "blob", *none)


#: Keys with findings are sent to all executors up to this many (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order that the scan gave."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, ledger: BlobLedger, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one); n_chars follows the text; rows and columns as they came, whatever their names.

    Null and empty texts hold nothing and stay as they are; rows with null or repeated ids are
    cleaned by their own text; texts of any length are scanned whole. An empty table gives an empty
    table.
    """
    found = ledger.scan(docs.select("doc_id", "text")).where(F.size("cover") > 0).select(F.col("doc_id").alias("path"), "blob", "cover").distinct()
    found = materialise(found, "redact-found")
    # only documents whose key has a finding are joined with the findings; the others pass where they lie
    keys = found.select(F.xxhash64("path").alias("key")).distinct()
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"))
    at = F.xxhash64(F.col("doc.doc_id")) == F.col("key")
    clean, some = rows.join(keys, at, "left_anti"), rows.join(keys, at, "left_semi")
    marked = some.join(found, F.col("doc.doc_id").eqNullSafe(F.col("path")) & (F.sha2("doc.text", 256) == F.col("blob")), "left")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    text = F.col("doc.text")
    hidden = F.aggregate(
        "cover",
        state,
        lambda s, c: F.struct(F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int")), F.lit(mark)).alias("out"), c["end"].alias("at")),
        lambda s: F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.length(text))),
    )
    hit = F.col("cover").isNotNull()
    cleaned = marked.withColumn("hidden", F.when(hit, hidden)).select(F.when(hit, F.col("doc").withField("text", F.col("hidden")).withField("n_chars", F.length("hidden").cast(docs.schema["n_chars"].dataType))).otherwise(F.col("doc")).alias("doc"))
    return clean.select("doc.*").unionByName(cleaned.select("doc.*"))
