"""Data contracts: declared columns against what a file holds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions.expressions import strict_date
from attesta.sources.config import ConfigError, Contract

VIOLATION = "file_name string, column_name string, violation_type string, severity string, violation_count long, sample_value string, contract_id string"
BLOCKING = "CRITICAL"
_TYPES = {
    "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "HUGEINT": "decimal(38,0)", "REAL": "float", "FLOAT": "float", "DOUBLE": "double",
    "DECIMAL": "decimal(18,3)", "NUMERIC": "decimal(18,3)", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "UUID": "string", "TEXT": "string", "STRING": "string",
}


def _castable(c: Column, data_type: str) -> Column:
    """The value in its declared type, null if it has another form."""
    if data_type == "DATE":
        return strict_date(c)
    name = data_type.strip().upper()
    kind = _TYPES.get(name) or (name.lower() if re.fullmatch(r"(DECIMAL|NUMERIC)\s*\(\s*\d+\s*(,\s*\d+\s*)?\)", name) else None)
    if kind is None:
        raise ConfigError(f"no type {data_type}")
    return F.trim(c).try_cast(kind)


def check_frame(df: DataFrame | None, file_name: str, contracts: list[Contract]) -> DataFrame:
    """Violations of one file (all columns text). None: the file is missing.

    The contracts of a file are checked in one pass: two counts and a sample (the smallest offending
    value) per column. Only approved contracts are enforced, and only they declare a column. Header
    names are compared as they are written.
    """
    spark = df.sparkSession if df is not None else None
    enforced = [c for c in contracts if c.enforced and c.file_name == file_name]
    if df is None:
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession().createDataFrame([(file_name, None, "FILE_MISSING", "CRITICAL", None, None, None)], VIOLATION)
    found: list[tuple] = []
    present = [c for c in enforced if c.column_name in df.columns]
    for c in enforced:
        if c not in present and c.is_required:
            found.append((file_name, c.column_name, "MISSING_COLUMN", "CRITICAL", None, None, c.contract_id))
    for name in df.columns:
        if name not in {c.column_name for c in enforced}:
            found.append((file_name, name, "NEW_COLUMN", "LOW", None, None, None))
    counts = []
    for n, c in enumerate(present):
        value = F.col(f"`{c.column_name}`")
        blank = value.isNull() | (F.trim(value) == "")
        wrong = ~blank & _castable(value, c.data_type).isNull() if c.data_type != "VARCHAR" else F.lit(False)
        counts += [F.count(F.when(wrong, 1)).alias(f"wrong_{n}"), F.min(F.when(wrong, F.trim(value))).alias(f"sample_{n}"), F.count(F.when(blank & F.lit(not c.is_nullable), 1)).alias(f"null_{n}")]
    if counts:
        row = df.agg(*counts).first()  # one row, a few numbers per declared column
        for n, c in enumerate(present):
            if row[f"wrong_{n}"]:
                found.append((file_name, c.column_name, "TYPE_MISMATCH", c.severity, row[f"wrong_{n}"], row[f"sample_{n}"], c.contract_id))
            if row[f"null_{n}"]:
                found.append((file_name, c.column_name, "NULL_VIOLATION", c.severity, row[f"null_{n}"], None, c.contract_id))
    return spark.createDataFrame(found, VIOLATION)


def run_row(violations: DataFrame, run_id: str, files: int) -> DataFrame:
    """One row for the run's check: files checked, violations by weight, and the verdict."""
    counts = violations.agg(F.count(F.when(F.col("severity") == BLOCKING, 1)).alias("critical_violations"), F.count("*").alias("total_violations"))
    verdict = F.when(F.col("critical_violations") > 0, "BLOCKED").when(F.col("total_violations") > 0, "WARNING").otherwise("PASSED")
    return counts.select(F.lit(run_id).alias("run_id"), F.lit(files).cast("long").alias("files_checked"), "critical_violations", "total_violations", verdict.alias("contract_status"))


def gate(violations: DataFrame) -> str:
    """BLOCKED with any critical violation, else WARNING with any, else PASSED."""
    critical, n = violations.agg(F.count(F.when(F.col("severity") == BLOCKING, 1)), F.count("*")).first()
    return "BLOCKED" if critical else "WARNING" if n else "PASSED"
