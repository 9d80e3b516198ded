"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: str | None = None


def get_spark(app: str = "attesta", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the engine is written for: AQE on, UTC, Arrow transfer.

    ``shuffle_partitions`` None leaves Spark's default, to be coalesced by AQE; on a cluster pass
    about (shuffled bytes / 128 MB).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master(f"local[{cores}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where it is unset."""
    global _LOCAL_SCRATCH
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = "file://" + tempfile.mkdtemp(prefix="attesta-")
    return _LOCAL_SCRATCH


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation, and values that
    depend on how rows were dealt out (partition ids, running totals) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attesta/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.attesta_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once everything that reads them has itself been written."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.attesta_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(column: str) -> str:
    """A column's name as ``select`` takes it, whatever characters it holds."""
    return "`" + column.replace("`", "``") + "`"


def spare_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores added, so that it is none of ``columns`` (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


_SHIPPED: set[str] = set()


#: Rows of an Arrow batch, in place of Spark's 10,000: a row may hold a long text, and both the executor and its Python worker hold batches.
BATCH_ROWS = 1000


def ship_code(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers (once per application), wherever they run.

    Sessions that leave Arrow batches at Spark's default get smaller ones.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="attesta-code-")) / "attesta.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
