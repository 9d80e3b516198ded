"""The training-data pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage but the last returns the columns of ``documents``. ``run`` writes each stage's result to
the shared folder and reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm.mixing import mix_documents
from attesta.llm.ngram_jaccard import keep_one
from attesta.llm.packing import pack
from attesta.llm.quality_fm import keep_good
from attesta.llm.queries import MIX_SEED, MIX_WEIGHTS, source_domain
from attesta.llm.secret_ledger import BlobLedger, redact
from attesta.session import materialise, ship_code

#: Share of the tokens that the mix keeps, in per cent.
MIX_PERCENT = 90


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.5 or more."""
    ship_code(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_train=5000, least=0.5)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    ship_code(spark)
    return keep_one(docs, n=5, threshold="0.8")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    ship_code(spark)
    return redact(docs, BlobLedger(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch of the mix to target weights."""
    ship_code(spark)
    return mix_documents(docs, source_domain(), MIX_WEIGHTS, MIX_PERCENT, MIX_SEED)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 4096 tokens, with their ids."""
    ship_code(spark)
    return pack(docs, window=4096, end_id=2).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier is trained, so SQL can't express the rows; tests/llm/test_pipeline.py compares them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
