"""Staged source views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

ATTRIBUTES = ["nik", "full_name", "phone", "email", "birth_date"]
SOURCE_COLUMNS = ["source_customer_id", *ATTRIBUTES]
SYSTEMS = {"CRM": "crm_customer.csv", "LOS": "los_customer.csv", "MOBILE": "mobile_customer.csv"}


def file_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column text (types are declared, never inferred); empty fields are null."""
    header = spark.read.option("header", True).option("escape", '"').csv(path).columns
    return spark.read.option("header", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in header)).csv(path)


def read_seed(spark: SparkSession, path: str, dates: tuple[str, ...] = ("birth_date",)) -> DataFrame:
    """A declared seed: text columns, and dates cast (an invalid date raises an error)."""
    raw = read_text_csv(spark, path)
    return raw.select(*[F.col(c).cast("date").alias(c) if c in dates else F.col(c) for c in raw.columns])


def stage_master(master: DataFrame) -> DataFrame:
    """Trimmed master rows; the key is left as it came."""
    return master.select("customer_id", F.trim("nik").alias("nik"), F.trim("full_name").alias("full_name"), F.trim("phone").alias("phone"), F.lower(F.trim("email")).alias("email"), "birth_date")


def stage_source(source: DataFrame, system: str) -> DataFrame:
    """Source rows with their system."""
    return source.select(F.lit(system).alias("source_system"), *SOURCE_COLUMNS)


def unify(sources: dict[str, DataFrame]) -> DataFrame:
    """All systems' rows, one after another."""
    return reduce(DataFrame.unionByName, [stage_source(df, system) for system, df in sources.items()])


def sources_of_table(customer: DataFrame) -> DataFrame:
    """Three derived source systems over the ``customer`` table, with gaps and conflicts at fixed places."""
    k = F.col("c_custkey")
    wide = lambda n, w: F.lpad(n.cast("string"), w, "0")
    nik = wide(F.lit(3200000000000000) + k, 16)
    phone = F.concat(F.lit("08"), wide((k * 7919) % 10000000000, 10))
    email = F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))
    born = F.date_add(F.lit("1960-01-01").cast("date"), (k % 15000).cast("int"))
    none = F.lit(None)
    crm = customer.select(
        F.concat(F.lit("CRM"), wide(k, 7)).alias("source_customer_id"), F.when(k % 17 == 0, none).when(k % 19 == 0, "12345").otherwise(nik).alias("nik"), F.col("c_name").alias("full_name"),
        F.when(k % 23 == 0, "ABC").otherwise(phone).alias("phone"), email.alias("email"), born.alias("birth_date"),
    )
    los = customer.where(k % 3 != 0).select(
        F.concat(F.lit("LOS"), wide(k, 7)).alias("source_customer_id"), nik.alias("nik"), F.upper("c_name").alias("full_name"), phone.alias("phone"),
        F.when(k % 5 == 0, none).when(k % 11 == 0, F.concat(F.lit("other"), k.cast("string"), F.lit("@example.com"))).otherwise(email).alias("email"), born.alias("birth_date"),
    )
    mobile = customer.where(k % 4 != 0).select(
        F.concat(F.lit("MOB"), wide(k, 7)).alias("source_customer_id"), F.when(k % 7 != 0, nik).alias("nik"), F.col("c_name").alias("full_name"), phone.alias("phone"), email.alias("email"),
        F.when(k % 13 != 0, born).alias("birth_date"),
    )
    return unify({"CRM": crm, "LOS": los, "MOBILE": mobile})


def master_of_table(customer: DataFrame) -> DataFrame:
    """A master file over the ``customer`` table: the CRM rows with a future date, a repeated and a missing key at fixed places."""
    crm = sources_of_table(customer).where("source_system = 'CRM'")
    k = F.substring("source_customer_id", 4, 20).cast("long")
    key = F.when(k % 97 == 0, F.lit(None)).when(k % 89 == 0, F.lit("CRM0000089")).otherwise(F.col("source_customer_id"))
    born = F.when(k % 83 == 0, F.lit("2999-01-01").cast("date")).otherwise(F.col("birth_date"))
    return crm.select(key.alias("customer_id"), "nik", "full_name", "phone", F.when(k % 31 == 0, F.concat(F.lit("user"), k.cast("string"), F.lit("@examplecom"))).otherwise(F.col("email")).alias("email"), born.alias("birth_date"))
