import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from attesta.session import get_spark

    session = get_spark("attesta-tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def awkward(spark):
    """Null fields, empty and very long texts, repeated rows, an extra column."""
    long_text = " ".join(f"word{i % 977} filler{i}" for i in range(30000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1", 10, "x"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1", 10, "x"),
        (2, None, "en", "s1", None, None),
        (3, "", None, None, 0, "y"),
        (4, " \n\t ", "en", None, 4, "y"),
        (5, "word", "en", "s2", 4, "y"),
        (6, long_text, "en", "s2", len(long_text), "z"),
        (7, long_text, None, "s2", len(long_text), "z"),
        (None, "some text without an id", "en", "s3", 3, "n"),
        (None, None, None, None, None, None),
        (8, "é" * 50 + " 漢字 " + "\U0001f600" * 3, "fr", "s3", 60, "w"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
