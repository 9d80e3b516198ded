"""The trust pipeline: from source files to the publication gate, as selectable stages.

Stages hand over tables of a ``TableStore``; a stage can be run again on its own. The time, the run
id and today's date are parameters, so a run can be repeated exactly.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.operators import attributes, golden, identity, review, rules, scoring
from attesta.reporting import dashboard, lineage, profile
from attesta.sources import config, contract, generate, staging
from attesta.sources.store import TableStore

_MEMBER = "golden_id string, source_system string, source_customer_id string, membership_status string, membership_confidence string"
_PROFILE = "golden_id string, nik string, full_name string, phone string, email string, birth_date date, entity_status string"
SCHEMAS = {
    "dq_run": "run_id string, started_at timestamp_ntz, status string, total_records long",
    "golden_entity_identity": "golden_id string, cluster_signature string, is_active boolean",
    "golden_entity": "golden_id string, entity_type string, entity_status string, has_conflict boolean, confidence string",
    "golden_entity_member": _MEMBER,
    "contract_run": "run_id string, files_checked long, critical_violations long, total_violations long, contract_status string, checked_at timestamp_ntz",
    "contract_violation": contract.VIOLATION + ", run_id string",
    "dq_result": "run_id string, rule_id string, status string, message string, record_id string",
    "dq_incident": "incident_id string, run_id string, rule_id string, dataset string, record_id string, severity string, incident_message string, incident_status string",
    "golden_customer_history": _PROFILE + ", valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean, change_reason string",
    "golden_entity_member_history": _MEMBER + ", valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean, change_reason string",
    "review_queue": ", ".join(f"{c} string" for c in review.QUEUE),
    "review_case": "case_id string, subject_type string, subject_key string, severity string, status string, evidence_count int, issue_types string, summary string, opened_at timestamp_ntz, closed_at timestamp_ntz",
    "identity_resolution_action": "action_id string, review_id string, action_type string, source_system string, source_customer_id string, golden_id string, performed_by string, reason string, created_at timestamp_ntz",
    "dq_attribute_result": "run_id string, source_system string, source_customer_id string, attribute_name string, attribute_value string, status string, message string, created_at timestamp_ntz",
    "quarantine_customer": "run_id string, customer_id string, rule_id string, dataset string, column_name string, original_value string, incident_id string, quarantine_status string",
    "dq_run_history": "run_id string, started_at timestamp_ntz",
}
KEYS = {"golden_entity_identity": ["golden_id"], "golden_entity": ["golden_id"], "review_queue": ["review_id"], "review_case": ["case_id"], "identity_resolution_action": ["action_id"], "golden_customer": ["golden_id"]}
GATES = {"contract", "source_gate", "publication_gate"}


class GateBlocked(RuntimeError):
    """A gate said BLOCKED in a strict run."""


class FreshStoreError(RuntimeError):
    """A run that leaves out staging on a store where nothing was staged."""


class StageFailed(RuntimeError):
    """A stage ended with an error, which is the cause."""


@dataclass
class Run:
    """One run: where things are, when it is, and how configuration is read."""

    spark: SparkSession
    store: TableStore
    run_id: str
    now: datetime
    master: DataFrame | None
    sources: dict[str, DataFrame]
    files: dict[str, DataFrame | None] = field(default_factory=dict)
    metadata: str = str(config.METADATA)
    data: str | None = None
    dashboard_path: str | None = None
    gates: dict[str, str] = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)

    def limits(self, scope: str) -> dict[str, float]:
        return config.thresholds(scope, f"{self.metadata}/thresholds.csv")

    def load(self) -> None:
        """Sources and files from the data folder; files that are not there are None."""
        names = ["customer.csv", *staging.SYSTEMS.values()]
        self.files = {n: staging.read_text_csv(self.spark, f"{self.data}/{n}") if staging.file_exists(self.spark, f"{self.data}/{n}") else None for n in names}
        seed = lambda n: staging.read_seed(self.spark, f"{self.data}/{n}")
        self.master = seed("customer.csv") if self.files["customer.csv"] is not None else None
        self.sources = {s: seed(n) for s, n in staging.SYSTEMS.items() if self.files[n] is not None}

    def rows(self, table: str) -> DataFrame:
        """This run's rows of a table that keeps those of all runs."""
        return self.store.read(table).where(F.col("run_id") == self.run_id)

    @property
    def at(self):
        return F.lit(self.now).cast("timestamp_ntz")

    @property
    def today(self):
        return F.lit(self.now.date() if isinstance(self.now, datetime) else date.today())


def _contract(run: Run) -> None:
    declared = config.contracts(f"{run.metadata}/contracts.csv")
    found = None
    for name in sorted({c.file_name for c in declared if c.enforced} & set(run.files)):
        rows = contract.check_frame(run.files[name], name, declared)
        found = rows if found is None else found.unionByName(rows)
    if found is not None:
        run.store.replace_run("contract_violation", found.withColumn("run_id", F.lit(run.run_id)), run.run_id)
        row = contract.run_row(run.rows("contract_violation"), run.run_id, len(run.files)).withColumn("checked_at", run.at)
        run.store.replace_run("contract_run", row, run.run_id)
        run.gates["contract"] = run.rows("contract_run").first()["contract_status"]


def _staging(run: Run) -> None:
    if run.master is None or set(run.sources) != set(staging.SYSTEMS):
        raise FileNotFoundError("a master file and one file for each source system are needed to stage sources")
    run.store.overwrite("stg_customer", staging.stage_master(run.master))
    run.store.overwrite("customer_unified", staging.unify(run.sources))


def _source_dq(run: Run) -> None:
    registry = config.rules(f"{run.metadata}/rules.csv")
    frame = rules.rule_frame(run.spark, registry)
    stg = run.store.read("stg_customer")
    store, total = run.store, stg.count()
    store.replace_run("dq_result", rules.run_rules(stg, registry, run.run_id), run.run_id)
    results = run.rows("dq_result")
    status = "FAILED" if not results.isEmpty() else "PASSED"
    store.replace_run("dq_run", run.spark.createDataFrame([(run.run_id, run.now, status, total)], SCHEMAS["dq_run"]), run.run_id)
    store.replace_run("dq_incident", rules.incidents(results, frame), run.run_id)
    store.replace_run("quarantine_customer", rules.quarantine(stg, results, frame), run.run_id)
    store.replace_run("dq_summary", rules.summary(frame, results, total).withColumn("run_id", F.lit(run.run_id)), run.run_id)


def _source_gate(run: Run) -> None:
    frame = rules.rule_frame(run.spark, config.rules(f"{run.metadata}/rules.csv"))
    run.gates["source_gate"] = rules.source_gate(run.rows("dq_result"), frame).first()["gate_status"]


def _eligible(run: Run) -> None:
    rows = rules.eligible(run.store.read("stg_customer"), run.store.read("quarantine_customer"), run.run_id)
    run.store.overwrite("eligible_customer", rows)
    run.store.overwrite("gold_customer", rules.gold(rows, run.at))


def _identity(run: Run) -> None:
    store, unified = run.store, run.store.read("customer_unified")
    pairs = store.overwrite("identity_match_candidate", identity.candidates(unified, config.signals(f"{run.metadata}/signals.csv")))
    matches = store.overwrite("identity_match", identity.decide(pairs, run.limits("identity_decision")))
    store.overwrite("identity_resolution_decision", identity.rank(matches))
    previous = store.read("golden_entity_member")
    registry = identity.bootstrap(store.read("golden_entity_identity"), store.read("golden_entity"), previous)
    steward = identity.steward_edges(store.read("identity_resolution_action"), previous, unified)
    clustered = identity.clusters(unified, matches, run.limits("identity_clustering")["trusted_edge_min_score"], steward)
    shapes = identity.entity_shapes(clustered, matches)
    found = store.overwrite("identified_cluster", identity.persistent_ids(shapes, registry, previous))
    store.overwrite("golden_entity_identity", identity.registry_after(registry, found))
    store.overwrite("golden_entity", identity.entities(found))
    members = store.overwrite("golden_entity_member", identity.members(found))
    store.overwrite("identity_metrics", identity.metrics(unified, matches, members, run.limits("identity_metrics")))


def _attribute_dq(run: Run) -> None:
    rows = attributes.attribute_results(run.store.read("customer_unified"), run.run_id, run.today).withColumn("created_at", run.at)
    run.store.replace_run("dq_attribute_result", rows, run.run_id)


def _golden(run: Run) -> None:
    store, unified = run.store, run.store.read("customer_unified")
    entities, members = store.read("golden_entity"), store.read("golden_entity_member")
    if entities.where("entity_status = 'ACTIVE'").isEmpty():
        raise RuntimeError("no active entity: survivorship has nothing to work on")
    verdicts = golden.latest_verdicts(store.read("dq_attribute_result"), ["created_at", "run_id"])
    picked = store.overwrite("golden_customer_attribute", golden.survivors(unified, entities, members, verdicts, config.priorities(f"{run.metadata}/survivorship.csv")))
    customers = store.overwrite("golden_customer", golden.profiles(entities, picked))
    tracked = [*staging.ATTRIBUTES, "entity_status"]
    store.overwrite("golden_customer_history", golden.history(store.read("golden_customer_history"), customers, ["golden_id"], tracked, run.at, "INITIAL"))
    store.overwrite("golden_entity_member_history", golden.history(store.read("golden_entity_member_history"), members, ["golden_id", *identity.RECORD], ["membership_status", "membership_confidence"], run.at, "MEMBER_ADDED"))
    store.overwrite("cross_source_consistency", golden.consistency(unified, entities, members))
    store.overwrite("golden_quality_score", golden.quality(entities, picked, run.limits("golden_quality")))


def _review(run: Run) -> None:
    store = run.store
    members = store.read("golden_entity_member")
    queue = store.overwrite("review_queue", review.rebuild_queue(store.read("review_queue"), review.issues(store.read("identity_match"), members, store.read("cross_source_consistency"))))
    rows = review.evidence(queue, members)
    store.overwrite("review_case_member", rows.select("case_id", "review_id", "issue_type", "severity"))
    store.overwrite("review_case", review.upsert_cases(store.read("review_case"), review.cases(rows), run.at))


def _scoring(run: Run) -> None:
    store, limits = run.store, run.limits("cdp_score")
    quality = store.read("golden_quality_score")
    dims = scoring.dimensions(store.read("stg_customer").count(), run.rows("quarantine_customer"), store.read("identity_metrics"), quality, store.read("cross_source_consistency"), store.read("review_queue"), limits)
    dims = store.overwrite("cdp_quality_dimension", scoring.overall(dims))
    store.overwrite("cdp_quality_score", scoring.overall_score(dims, quality, limits))


def _publication_gate(run: Run) -> None:
    store = run.store
    gate = store.overwrite("cdp_quality_gate", scoring.publication_gate(store.read("cdp_quality_score"), run.rows("dq_summary"), store.read("golden_entity"), store.read("review_queue"), run.limits("cdp_gate")))
    run.gates["publication_gate"] = gate.first()["gate_status"]


def _reporting(run: Run) -> None:
    store = run.store
    store.overwrite("golden_lineage", lineage.build(store.read("golden_customer_attribute"), store.read("dq_attribute_result"), store.read("golden_entity_member"), store.read("identity_resolution_action"), store.read("golden_entity"), run.run_id, ["created_at", "run_id"]))
    row = scoring.run_snapshot(run.run_id, run.at, store.read("stg_customer").count(), run.rows("quarantine_customer"), run.rows("dq_summary"), store.read("golden_entity"), store.read("golden_customer"), store.read("golden_quality_score"), store.read("review_queue"), store.read("cdp_quality_score"), store.read("cdp_quality_gate"))
    store.replace_run("dq_run_history", row, run.run_id)
    store.overwrite("dq_run_trend", scoring.trend(store.read("dq_run_history"), states=("gate_status",)))


def _dashboard(run: Run) -> None:
    if run.dashboard_path is None:
        return
    store = run.store
    score, gate = store.read("cdp_quality_score").first(), store.read("cdp_quality_gate").first()
    cards = {"overall score": score["overall_score"], "status": score["overall_status"], "records": store.read("stg_customer").count(), "quarantined": run.rows("quarantine_customer").select("customer_id").distinct().count(), "golden customers": store.read("golden_customer").count(), "open reviews": store.read("review_queue").where("status = 'OPEN'").count()}
    order = {
        "cdp_quality_dimension": ["dimension"], "dq_summary": ["rule_id"], "identity_metrics": ["total_pairs"], "golden_quality_score": ["golden_id"], "cross_source_consistency": ["golden_id", "attribute_name"], "review_case": ["case_id"],
        "review_queue": ["review_id"], "golden_customer": ["golden_id"], "golden_lineage": ["golden_id", "attribute_name"], "golden_customer_history": ["golden_id"], "dq_run_history": ["started_at"], "dq_run_trend": ["started_at"], "contract_run": ["checked_at"], "identity_match": ["source_customer_id"],
        "review_case_member": ["case_id", "review_id"],
    }
    page = dashboard.render(f"Run {run.run_id}", cards, gate["gate_status"], gate["blocking_reasons"] or gate["warning_reasons"], {t: (run.rows(t) if t == "dq_summary" else store.read(t), o) for t, o in order.items()})
    with open(run.dashboard_path, "w", encoding="utf-8") as f:
        f.write(page)


def _generate(run: Run) -> None:
    if run.data is None:
        raise ValueError("generating sources needs a data folder")
    generate.generate(run.spark, run.data)
    run.load()


def _test(run: Run) -> None:
    run.store.overwrite("staging_test", profile.staging_tests(run.store.read("stg_customer"), run.today))


STAGES: dict[str, Callable[[Run], None]] = {
    "contract": _contract, "staging": _staging, "source_dq": _source_dq, "source_gate": _source_gate, "eligible": _eligible, "identity": _identity, "attribute_dq": _attribute_dq,
    "golden": _golden, "review": _review, "scoring": _scoring, "publication_gate": _publication_gate, "reporting": _reporting, "dashboard": _dashboard,
}


#: Stages that run only when they are asked for.
OPT_IN: dict[str, Callable[[Run], None]] = {"generate": _generate, "test": _test}


def select_stages(only: list[str] | None = None, start: str | None = None, generate: bool = False, test: bool = False) -> list[str]:
    """Names to run: ``only`` in its own order, whatever else is given; else all from ``start`` on (an opt-in stage: that alone), with the opt-in stages asked for before and after."""
    names = list(STAGES)
    if unknown := [n for n in [*(only or []), *([start] if start else [])] if n not in STAGES and n not in OPT_IN]:
        raise KeyError(f"no stage {', '.join(unknown)}")
    if only:
        return list(only)
    chosen = names if start is None else [start] if start in OPT_IN else names[names.index(start) :]
    return [*(["generate"] if generate else []), *chosen, *(["test"] if test else [])]


def execute(run: Run, stages: list[str], strict: bool = False) -> Run:
    """Run stages in order. The first that fails ends the run; a blocked gate does so only if ``strict``.

    A run that does not check the sources again belongs to the latest run that did. Stages that read
    what others write are refused on a store that has none of it.
    """
    if "staging" not in stages and not run.store.exists("stg_customer") and set(stages) - {"contract", "generate"}:
        raise FreshStoreError("the store holds no staged sources: run the staging stage first")
    if "source_dq" not in stages:
        last = run.store.read("dq_run").orderBy(F.desc("started_at"), F.desc("run_id")).first()
        run.run_id = last["run_id"] if last else run.run_id
    for name in stages:
        began = time.monotonic()
        try:
            {**STAGES, **OPT_IN}[name](run)
        except Exception as error:
            raise StageFailed(name) from error
        finally:
            run.timings[name] = time.monotonic() - began
        if strict and name in GATES and run.gates.get(name) == "BLOCKED":
            raise GateBlocked(name)
    return run
