"""Registered queries of the trust engine and their SQL equivalents.

Every query runs its operators over three source systems derived from the ``customer`` table, or
over other driver tables, whole. The SQL is written apart from the operators, for DuckDB.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.functions.expressions import uuid5
from attesta.operators import attributes, golden, identity, review, rules, scoring
from attesta.reporting import lineage, profile
from attesta.session import materialise
from attesta.sources import config, contract, staging

RUN = "RUN-1"
TODAY = datetime.date(2026, 1, 1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unified(spark, sf_dir):
    return staging.sources_of_table(_table(spark, sf_dir, "customer"))


def master(spark, sf_dir):
    return staging.stage_master(staging.master_of_table(_table(spark, sf_dir, "customer")))


def _matches(spark, sf_dir):
    return identity.decide(identity.candidates(unified(spark, sf_dir), config.signals()), config.thresholds("identity_decision"))


def _identified(spark, sf_dir):
    """(unified, matches, entities with ids): matches and entities written once, as several steps read them."""
    u, m = unified(spark, sf_dir), materialise(_matches(spark, sf_dir), "matches")
    shapes = materialise(identity.entity_shapes(identity.clusters(u, m, config.thresholds("identity_clustering")["trusted_edge_min_score"]), m), "shapes")
    return u, m, materialise(identity.fresh_ids(shapes), "identified")


def _golden(spark, sf_dir):
    u, m, found = _identified(spark, sf_dir)
    entities, members = identity.entities(found), identity.members(found)
    verdicts = attributes.attribute_results(u, RUN, F.lit(TODAY))
    return u, m, entities, members, verdicts, golden.survivors(u, entities, members, verdicts, config.priorities())


def _source_dq(spark, sf_dir):
    stg, registry = master(spark, sf_dir), config.rules()
    frame = rules.rule_frame(spark, registry)
    results = rules.run_rules(stg, registry, RUN)
    return stg, frame, results


def _summary(spark, sf_dir):
    stg, frame, results = _source_dq(spark, sf_dir)
    return rules.summary(frame, results, stg.count())


def _score_parts(spark, sf_dir):
    u, m, entities, members, verdicts, picked = _golden(spark, sf_dir)
    stg, frame, results = _source_dq(spark, sf_dir)
    picked = materialise(picked, "survivors")
    quality = golden.quality(entities, picked, config.thresholds("golden_quality"))
    agree = materialise(golden.consistency(u, entities, members), "consistency")
    queue = materialise(review.issues(m, members, agree), "queue")
    n = stg.count()
    summary = rules.summary(frame, results, n)
    bad = rules.quarantine(stg, results, frame)
    dims = scoring.dimensions(n, bad, identity.metrics(u, m, members, config.thresholds("identity_metrics")), quality, agree, queue, config.thresholds("cdp_score"))
    return dims, quality, summary, entities, queue


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on the order of rows in their last digits; six decimals do not."""
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- queries -----------------------------------------------------------------------------------


def staging_unified(spark, sf_dir):
    return unified(spark, sf_dir)


def contract_check(spark, sf_dir):
    u = unified(spark, sf_dir).where("source_system = 'CRM'").select(*[F.col(c).cast("string").alias(c) for c in staging.SOURCE_COLUMNS if c != "email"], F.lit("x").alias("extra"))
    u = u.withColumn("birth_date", F.when(F.substring("source_customer_id", 4, 20).cast("long") % 41 == 0, F.date_format(F.col("birth_date").cast("date"), "dd/MM/yyyy")).otherwise(F.col("birth_date"))).withColumn("source_customer_id", F.when(F.substring("source_customer_id", 4, 20).cast("long") % 43 == 0, " ").otherwise(F.col("source_customer_id")))
    return contract.check_frame(u, "crm_customer.csv", config.contracts())


def dq_rule_results(spark, sf_dir):
    return _source_dq(spark, sf_dir)[2]


def dq_rule_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


def source_gate(spark, sf_dir):
    _, frame, results = _source_dq(spark, sf_dir)
    return rules.source_gate(results, frame)


def quarantine(spark, sf_dir):
    stg, frame, results = _source_dq(spark, sf_dir)
    return rules.quarantine(stg, results, frame).drop("incident_id")


def incidents(spark, sf_dir):
    _, frame, results = _source_dq(spark, sf_dir)
    return rules.incidents(results, frame)


def eligible_rows(spark, sf_dir):
    stg, frame, results = _source_dq(spark, sf_dir)
    return rules.eligible(stg, rules.quarantine(stg, results, frame), RUN)


def order_rules(spark, sf_dir):
    """The rule engine over another dataset: a foreign key, a range and a uniqueness rule on order lines."""
    registry = [
        config.Rule("ORD-1", "lines", "l_orderkey", "Integrity", "order exists", "HIGH", "PASS_RATE", 100.0, "APPROVED", "l_orderkey NOT IN (SELECT o_orderkey FROM open_orders)"),
        config.Rule("ORD-2", "lines", "l_discount", "Validity", "small discount", "LOW", "FAILURE_RATE", 10.0, "APPROVED", "l_discount > 0.09 AND l_quantity < 3"),
        config.Rule("ORD-3", "lines", "line_id", "Uniqueness", "line once", "CRITICAL", "PASS_RATE", 100.0, "APPROVED", "line_id IN (SELECT line_id FROM main.lines GROUP BY line_id HAVING COUNT(*) > 1)"),
    ]
    _table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey").createOrReplaceTempView("open_orders")
    lines = _table(spark, sf_dir, "lineitem").withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    results = rules.run_rules(lines, registry, RUN, key="line_id")
    return rules.summary(rules.rule_frame(spark, registry), results, lines.count()).select("rule_id", "failed_records", "pass_rate", "status")


def profile_overview(spark, sf_dir):
    return profile.overview(unified(spark, sf_dir), staging.SOURCE_COLUMNS)


def profile_duplicates(spark, sf_dir):
    return profile.duplicates(unified(spark, sf_dir), "phone")


def profile_length_hist(spark, sf_dir):
    return profile.length_histogram(unified(spark, sf_dir), "nik")


def profile_format_status(spark, sf_dir):
    return profile.format_status(unified(spark, sf_dir), "phone", r"^08[0-9]{8,13}\z")


def profile_ages(spark, sf_dir):
    return profile.ages(unified(spark, sf_dir), "birth_date", F.lit(TODAY))


def staging_tests(spark, sf_dir):
    return profile.staging_tests(master(spark, sf_dir), F.lit(TODAY))


def attribute_dq(spark, sf_dir):
    return attributes.attribute_results(unified(spark, sf_dir), RUN, F.lit(TODAY))


def identity_candidates(spark, sf_dir):
    return identity.candidates(unified(spark, sf_dir), config.signals())


def identity_decision(spark, sf_dir):
    return _matches(spark, sf_dir).select(*identity.RECORD, *identity.CANDIDATE, "match_score", "match_status", "matched_on", "reason")


def identity_rank(spark, sf_dir):
    return identity.rank(_matches(spark, sf_dir))


def identity_clusters(spark, sf_dir):
    u, m, found = _identified(spark, sf_dir)
    return found.select("golden_id", F.array_join("members", "|").alias("members"), "has_conflict", "cluster_signature")


def golden_members(spark, sf_dir):
    return identity.members(_identified(spark, sf_dir)[2])


def unresolved_records(spark, sf_dir):
    u, _, found = _identified(spark, sf_dir)
    return identity.unresolved(u, identity.members(found)).select(*identity.RECORD)


def identity_metrics(spark, sf_dir):
    u, m, found = _identified(spark, sf_dir)
    return identity.metrics(u, m, identity.members(found), config.thresholds("identity_metrics"))


def golden_attributes(spark, sf_dir):
    return _golden(spark, sf_dir)[5]


def golden_customer(spark, sf_dir):
    _, _, entities, _, _, picked = _golden(spark, sf_dir)
    return golden.profiles(entities, picked)


def cross_source_consistency(spark, sf_dir):
    u, _, found = _identified(spark, sf_dir)
    return golden.consistency(u, identity.entities(found), identity.members(found))


def golden_quality(spark, sf_dir):
    _, _, entities, _, _, picked = _golden(spark, sf_dir)
    return golden.quality(entities, picked, config.thresholds("golden_quality"))


def scd2_customers(spark, sf_dir):
    """Type-2 history over two versions of the CRM rows: changed, gone and new keys."""
    t1, t2 = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2026-02-01 00:00:00").cast("timestamp_ntz")
    k = F.substring("source_customer_id", 4, 20).cast("long")
    one = unified(spark, sf_dir).where("source_system = 'CRM'").drop("source_system")
    two = one.where(k % 37 != 0).withColumn("phone", F.when(k % 29 == 0, "0800000000").otherwise(F.col("phone"))).withColumn("email", F.when(k % 58 == 0, None).otherwise(F.col("email")))
    one = one.where(k % 41 != 0)
    empty = one.limit(0).withColumns({"valid_from": t1, "valid_to": t1, "is_current": F.lit(True), "change_reason": F.lit("")})
    first = materialise(golden.history(empty, one, ["source_customer_id"], staging.ATTRIBUTES, t1, "INITIAL"), "history")
    return golden.history(first, two, ["source_customer_id"], staging.ATTRIBUTES, t2, "INITIAL")


def review_queue(spark, sf_dir):
    u, m, found = _identified(spark, sf_dir)
    return review.issues(m, identity.members(found), golden.consistency(u, identity.entities(found), identity.members(found))).drop("review_id")


def review_cases(spark, sf_dir):
    u, m, found = _identified(spark, sf_dir)
    members = identity.members(found)
    return review.cases(review.evidence(review.issues(m, members, golden.consistency(u, identity.entities(found), members)), members)).drop("case_id")


def review_ids(spark, sf_dir):
    """Name-based ids of customers: the ids of reviews and cases are made this way."""
    return _table(spark, sf_dir, "customer").select("c_custkey", uuid5(F.concat_ws("|", F.lit("POSSIBLE_MATCH"), F.col("c_name"))).alias("review_id"))


def score_dimensions(spark, sf_dir):
    return _rounded(scoring.overall(_score_parts(spark, sf_dir)[0]), "score", "contribution")


def overall_score(spark, sf_dir):
    dims, quality, *_ = _score_parts(spark, sf_dir)
    return _rounded(scoring.overall_score(dims, quality, config.thresholds("cdp_score")), "overall_score")


def publication_gate(spark, sf_dir):
    dims, quality, summary, entities, queue = _score_parts(spark, sf_dir)
    return _rounded(scoring.publication_gate(scoring.overall_score(dims, quality, config.thresholds("cdp_score")), summary, entities, queue, config.thresholds("cdp_gate")), "overall_score")


def golden_lineage(spark, sf_dir):
    u, m, entities, members, verdicts, picked = _golden(spark, sf_dir)
    newest = members.withColumn("k", F.expr("cast(substring(source_customer_id, 4, 20) as bigint)")).where("k % 10 = 0")
    actions = newest.select(F.concat(F.lit("A"), F.col("source_customer_id")).alias("action_id"), F.when(F.col("k") % 20 == 0, F.col("golden_id")).otherwise("G999999").alias("golden_id"), *identity.RECORD, F.lit("APPROVED").alias("action_type"), F.lit("STEWARD").alias("performed_by"), F.col("k").alias("created_at"))
    return lineage.build(picked, verdicts, members, actions, entities, RUN, ["run_id"])


def rejected_values(spark, sf_dir):
    _, _, _, members, verdicts, _ = _golden(spark, sf_dir)
    return lineage.rejected(verdicts, members)


def run_trend(spark, sf_dir):
    """Each day of events as a run: events, users and value beside the day before."""
    days = _table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("started_at")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    return scoring.trend(days.withColumn("run_id", F.date_format("started_at", "yyyyMMdd")), {"events": True, "users": False})


def latest_per_key(spark, sf_dir):
    """The newest event of each user."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _table(spark, sf_dir, "events").withColumn("place", F.row_number().over(by)).where("place = 1").select("user_id", "event_id", "event_type", "value")


_NAMES = [
    staging_unified, contract_check, dq_rule_results, dq_rule_summary, source_gate, quarantine, incidents, eligible_rows, order_rules, profile_overview, profile_duplicates, profile_length_hist, profile_format_status, profile_ages, staging_tests,
    attribute_dq, identity_candidates, identity_decision, identity_rank, identity_clusters, golden_members, unresolved_records, identity_metrics, golden_attributes, golden_customer, cross_source_consistency, golden_quality, scd2_customers,
    review_queue, review_cases, review_ids, score_dimensions, overall_score, publication_gate, golden_lineage, rejected_values, run_trend, latest_per_key,
]
QUERIES = {f.__name__: f for f in _NAMES}

# imported last: the SQL needs nothing of the above
from attesta.catalog_sql import ORACLE_SQL  # noqa: E402, F401
