"""Tables as versioned Parquet snapshots.

A table is a folder of versions and of pointers, of which the newest names the one that counts; a
pointer is written last and never changed, so a reader never sees half a table and a run that dies
leaves the old one. Tables with rows of each run have such a folder for each run. Works on any file
system that Spark's Hadoop layer reaches.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class ConstraintError(ValueError):
    """Rows that break a table's key or a column that must not be null."""


class TableStore:
    """Tables under ``root``; ``schemas`` (DDL) name the columns that a read must have."""

    KEEP = 5  # versions of a table (or of a run's part of it) that stay

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None, keys: dict[str, list[str]] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {t: StructType.fromDDL(d) for t, d in (schemas or {}).items()}
        self.keys = keys or {}

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _pointers(self, name: str) -> list[str]:
        """Names of the pointers, in the order of their making; each names a version and is never changed."""
        return sorted(n for n in self._names(f"{self.root}/{name}") if n.startswith("POINTER-"))

    def _current(self, name: str) -> list[str]:
        """Folders that make up the table: the version that the newest pointer names, and that of each run."""
        parts = [name, *[f"{name}/{n}" for n in sorted(self._names(f"{self.root}/{name}")) if n.startswith("run=")]]
        return [f"{self.root}/{part}/v-{newest[-1].split('-', 2)[2]}" for part in parts if (newest := self._pointers(part))]

    def exists(self, name: str) -> bool:
        return bool(self._current(name))

    def read(self, name: str) -> DataFrame:
        """The table; columns added to its schema since it was written are null, a table never written is empty."""
        folders = self._current(name)
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        df = self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*folders)
        if name in self.schemas:
            df = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schemas[name] if f.name not in df.columns])
        return df

    def _point(self, name: str, version: str) -> None:
        """A pointer to the version, beside the older ones: a reader sees the last before or this one, whenever a run dies.

        Of the versions the newest ``KEEP`` stay, as frames read before may still be lazy.
        """
        old = self._pointers(name)
        number = int(old[-1].split("-")[1]) + 1 if old else 0
        fs, temp = self._fs(f"{self.root}/{name}/.{version}")
        fs.create(temp, True).close()
        target = self._fs(f"{self.root}/{name}/POINTER-{number:012d}-{version.removeprefix('v-')}")[1]
        if not fs.rename(temp, target):
            raise OSError(f"{name}: the pointer could not be written")
        for pointer in old[: 1 - self.KEEP]:
            fs.delete(self._fs(f"{self.root}/{name}/{pointer}")[1], False)
            fs.delete(self._fs(f"{self.root}/{name}/v-{pointer.split('-', 2)[2]}")[1], True)

    def overwrite(self, name: str, df: DataFrame) -> DataFrame:
        """A new snapshot in place of the table; the key, where one is declared, must be unique and not null."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        new = self.spark.read.parquet(f"{self.root}/{name}/{version}")
        if key := self.keys.get(name):
            bad = new.groupBy(*key).agg(F.count("*").alias("n")).where(F.expr("n > 1") | (F.greatest(*[F.col(k).isNull().cast("int") for k in key], F.lit(0)) > 0))
            if not bad.isEmpty():
                raise ConstraintError(f"{name}: {key} repeats or is null")
        self._point(name, version)
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        return self.overwrite(name, self.read(name).unionByName(rows, allowMissingColumns=True))

    def replace_run(self, name: str, rows: DataFrame, run_id: str) -> DataFrame:
        """The run's rows anew: the same run twice gives the same table. A run has a folder of its own, so other runs' rows are not touched."""
        part = f"{name}/run={quote(run_id, safe='')}"
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{part}/{version}")
        self._point(part, version)
        return self.read(name)

    def insert_absent(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows whose key is new; of several with one key one."""
        key = self.keys[name]
        old = self.read(name)
        return self.overwrite(name, old.unionByName(rows.dropDuplicates(key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True))

    def upsert(self, name: str, rows: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Rows by key: new ones added, old ones replaced but for the columns in ``keep``."""
        key, old = self.keys[name], self.read(name)
        kept = old.select(*key, *[F.col(c).alias(f"_{c}") for c in keep], F.lit(True).alias("_had"))
        merged = rows.join(kept, key, "left").select(*key, *[F.when(F.col("_had"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in rows.columns if c not in key])
        return self.overwrite(name, old.join(rows.select(*key), key, "left_anti").unionByName(merged, allowMissingColumns=True))
