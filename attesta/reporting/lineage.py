"""Where every surviving value came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from attesta.operators.golden import latest_verdicts
from attesta.operators.identity import RECORD


def latest_actions(actions: DataFrame, order: str = "created_at") -> DataFrame:
    """The newest decision on each record, for whichever entity it was."""
    by = Window.partitionBy(*RECORD).orderBy(F.desc_nulls_last(order), F.desc("action_id"))
    return actions.withColumn("place", F.row_number().over(by)).where("place = 1")


def build(attributes: DataFrame, results: DataFrame, members: DataFrame, actions: DataFrame, entities: DataFrame, run_id: str, verdict_order: list[str]) -> DataFrame:
    """golden_lineage: each survivor with its verdict, membership, steward decision (only if the newest one is for this entity) and entity."""
    verdict = latest_verdicts(results, verdict_order).select(*RECORD, "attribute_name", F.col("status").alias("attribute_dq_status"), F.col("message").alias("attribute_dq_message"))
    action = latest_actions(actions).select("golden_id", *RECORD, F.col("action_type").alias("resolution_action"), F.col("performed_by").alias("resolved_by"))
    entity = entities.select("golden_id", "entity_status", F.col("confidence").alias("entity_confidence"))
    rows = attributes.join(verdict, [*RECORD, "attribute_name"], "left").join(members.select("golden_id", *RECORD, "membership_status", "membership_confidence"), ["golden_id", *RECORD], "left").join(action, ["golden_id", *RECORD], "left").join(entity, "golden_id", "left")
    return rows.select("golden_id", "attribute_name", "attribute_value", *RECORD, "source_priority", "dq_eligible", "attribute_dq_status", "attribute_dq_message", "membership_status", "membership_confidence", "resolution_action", "resolved_by", "entity_status", "entity_confidence", "selection_reason", F.lit(run_id).alias("run_id"))


def rejected(results: DataFrame, members: DataFrame) -> DataFrame:
    """Values of members that failed quality, each once."""
    return results.where("status = 'FAIL'").join(members.select("golden_id", *RECORD), RECORD).select("golden_id", *RECORD, "attribute_name", "attribute_value", "message").distinct()


def explain(golden_id: str, entities: DataFrame, members: DataFrame, actions: DataFrame, lineage: DataFrame, results: DataFrame) -> str:
    """All about one entity, as text (a few rows each)."""
    entity = entities.where(F.col("golden_id") == golden_id).first()
    if entity is None:
        return f"{golden_id}: no such entity"
    lines = [f"{golden_id}: {entity['entity_status']}, confidence {entity['confidence']}", "members:"]
    lines += [f"  {r.source_system}:{r.source_customer_id} {r.membership_status}/{r.membership_confidence}" for r in members.where(F.col("golden_id") == golden_id).orderBy(*RECORD).collect()]
    lines.append("steward decisions:")
    lines += [f"  {r.action_type} {r.source_system}:{r.source_customer_id} by {r.performed_by}: {r.reason}" for r in actions.where(F.col("golden_id") == golden_id).orderBy("action_id").collect()] or ["  none"]
    lines.append("surviving values:")
    lines += [f"  {r.attribute_name} = {r.attribute_value}  from {r.source_system}:{r.source_customer_id} (priority {r.source_priority}, {r.attribute_dq_message})" for r in lineage.where(F.col("golden_id") == golden_id).orderBy("attribute_name").collect()] or ["  none"]
    lines.append("rejected values:")
    lines += [f"  {r.attribute_name} = {r.attribute_value}  from {r.source_system}:{r.source_customer_id} ({r.message})" for r in rejected(results, members).where(F.col("golden_id") == golden_id).orderBy("attribute_name", *RECORD).collect()] or ["  none"]
    return "\n".join(lines)
