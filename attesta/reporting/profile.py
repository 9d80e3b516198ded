"""Read-only profiles of a table of people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def overview(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, total, nulls, distinct_values) for each column, from one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in columns], *[F.countDistinct(c).alias(f"d_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("total"), (F.col("n") - F.col(f"c_{c}")).alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])
    return row.select(F.explode(each).alias("r")).select("r.*")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.length(column).cast("long").alias("len")).agg(F.count("*").alias("n"))


def format_status(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows by NULL, VALID or INVALID."""
    status = F.when(F.col(column).isNull(), "NULL").when(F.col(column).rlike(pattern), "VALID").otherwise("INVALID")
    return df.groupBy(status.alias("format_status")).agg(F.count("*").alias("n"))


def ages(df: DataFrame, column: str, today: Column) -> DataFrame:
    """Oldest and youngest date, and the span of calendar years to today."""
    years = F.year(today) - F.year(column)
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"), F.min(years).cast("long").alias("min_years"), F.max(years).cast("long").alias("max_years"), F.count(F.when(F.col(column) > today, 1)).alias("future"))


def failing_tests(df: DataFrame, tests: dict[str, Column], unique: tuple[str, ...] = ()) -> DataFrame:
    """(test_name, failing): row-level tests in one pass; for each column of ``unique`` the values, null aside, that occur more than once."""
    row = df.agg(*[F.count(F.when(c, 1)).alias(f"t{k}") for k, c in enumerate(tests.values())])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("test_name"), F.col(f"t{k}").alias("failing")) for k, n in enumerate(tests)])).alias("r")).select("r.*")
    for c in unique:
        twice = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("failing"))
        out = out.unionByName(twice.select(F.lit(f"unique_{c}").alias("test_name"), "failing"))
    return out


def staging_tests(df: DataFrame, today: Column) -> DataFrame:
    """The tests of the staged master rows."""
    tests = {
        "not_null_customer_id": F.col("customer_id").isNull(), "not_null_nik": F.col("nik").isNull(), "not_null_email": F.col("email").isNull(), "valid_nik": F.col("nik").isNotNull() & ~F.col("nik").rlike(r"^[0-9]{16}\z"),
        "valid_phone": F.col("phone").isNotNull() & ~F.col("phone").rlike(r"^08[0-9]{8,13}\z"), "valid_email": F.col("email").isNotNull() & ~F.lower("email").rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"),
        "valid_birth_date": F.col("birth_date") > today,
    }
    return failing_tests(df, tests, ("customer_id", "nik"))
