"""Made-up source files to try the pipeline on, and copies of files between folders.

A master file of people with four defects at fixed rows, and three source systems over its first
four people, with gaps and conflicts, beside people that only one system knows. Rows follow from the
row number alone, so the same call gives the same file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta.sources.staging import SYSTEMS

PEOPLE = 4
_FIRST = ["Ana", "Budi", "Citra", "Dewi", "Eka", "Fajar", "Gita", "Hadi", "Intan", "Joko"]
_LAST = ["Halim", "Kusuma", "Lestari", "Nugroho", "Pratama", "Rahayu", "Santoso", "Wijaya"]


def cleaned(value: Column) -> Column:
    """Without outer white space, and without the .0 that spreadsheets add to digits; an empty value is null."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", ""), r"^([0-9]+)\.0$", "$1")
    return F.when(text != "", text)


def master_file(spark: SparkSession, rows: int = 1000) -> DataFrame:
    """People C00000 on: row 10 has no nik, row 20 the phone ABC, row 30 a date of birth to come, row 40 the nik of row 0."""
    i = F.col("id")
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    pick = lambda names, salt: F.element_at(F.array(*map(F.lit, names)), (draw(salt, len(names)) + 1).cast("int"))
    nik = lambda n: (F.lit(3200000000000000) + n * 97).cast("string")
    first, last = pick(_FIRST, 1), pick(_LAST, 2)
    born = F.date_add(F.lit("1965-01-01").cast("date"), draw(3, 15000).cast("int"))
    return spark.range(rows).select(
        F.format_string("C%05d", i).alias("customer_id"), F.when(i == 10, None).when(i == 40, nik(F.lit(0))).otherwise(nik(i)).alias("nik"), F.concat_ws(" ", first, last).alias("full_name"),
        F.when(i == 20, "ABC").otherwise(F.format_string("08%010d", draw(4, 10_000_000_000))).alias("phone"), F.lower(F.concat(first, F.lit("."), last, i.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(i == 30, F.lit("2999-01-01").cast("date")).otherwise(born).cast("string").alias("birth_date"),
    )


def source_files(master: DataFrame) -> dict[str, DataFrame]:
    """Rows of each system. The second person is a match of two records without a third's nik, the third and fourth conflict or lack an e-mail address."""
    people = [f"C{k:05d}" for k in range(1, PEOPLE + 1)]
    if master.where(F.col("customer_id").isin(people)).select("customer_id").distinct().count() < PEOPLE:
        raise ValueError(f"the master file lacks some of {', '.join(people)}")
    base = master.where(F.col("customer_id").isin(people)).select(F.substring("customer_id", 2, 5).cast("int").alias("k"), *[cleaned(F.col(c)).alias(c) for c in ("nik", "full_name", "phone", "email", "birth_date")])
    k, none = F.col("k"), F.lit(None).cast("string")
    changes = {
        "CRM": {"full_name": F.when(k == 3, F.concat(F.col("full_name"), F.lit(" Putra"))).otherwise(F.col("full_name"))},
        "LOS": {"full_name": F.when(k == 1, F.upper("full_name")).otherwise(F.col("full_name")), "email": F.when(k == 3, F.lit("somebody.else@example.com")).when(k == 4, none).otherwise(F.col("email"))},
        "MOBILE": {"nik": F.when(k == 2, none).otherwise(F.col("nik")), "email": F.when(k == 1, none).otherwise(F.col("email"))},
    }
    out = {}
    for n, (system, changed) in enumerate(changes.items()):
        rows = base.withColumns(changed).withColumn("source_customer_id", F.format_string(f"{system[:3]}%03d", k)).drop("k")
        alone = master.sparkSession.createDataFrame([(f"{system[:3]}005", f"32990000000000{n:02d}", f"Only {system.title()}", f"0899000000{n:02d}", f"only{n}@example.com", "1990-01-01")], "source_customer_id string, nik string, full_name string, phone string, email string, birth_date string")
        out[system] = rows.select(*alone.columns).unionByName(alone)
    return out


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in place of one that is there; for files of a size that one task can write."""
    spark, made = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(made)
    fs, folder = _files(spark, made)
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    target = _files(spark, path)[1]
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")
    fs.delete(folder, True)


def generate(spark: SparkSession, folder: str, rows: int = 1000) -> list[str]:
    """Writes the source files to ``folder``, and a master file if it has none; the names written."""
    fs, master = _files(spark, f"{folder}/customer.csv")
    done = []
    if not fs.exists(master):
        write_csv(master_file(spark, rows), f"{folder}/customer.csv")
        done.append("customer.csv")
    given = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/customer.csv")
    for system, df in source_files(given).items():
        write_csv(df, f"{folder}/{SYSTEMS[system]}")
        done.append(SYSTEMS[system])
    return done


def sync_seeds(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copies the master and source files that ``source`` has to ``target``; the names copied, missing ones skipped."""
    done = []
    for name in ["customer.csv", *SYSTEMS.values()]:
        fs, path = _files(spark, f"{source}/{name}")
        if fs.exists(path):
            to_fs, to = _files(spark, f"{target}/{name}")
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, to_fs, to, False, True, spark.sparkContext._jsc.hadoopConfiguration())
            done.append(name)
    return done
