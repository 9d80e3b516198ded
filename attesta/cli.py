"""Command line: run the pipeline, take review decisions, explain an entity."""

from __future__ import annotations

import argparse
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from attesta import trust
from attesta.operators import review, scoring
from attesta.reporting import lineage
from attesta.session import get_spark, ship_code
from attesta.sources import staging
from attesta.sources.store import TableStore


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attesta")
    top.add_argument("--store", required=True, help="folder of the tables")
    parts = top.add_subparsers(dest="command", required=True)
    run = parts.add_parser("run", help="run the pipeline")
    run.add_argument("--data", help="folder with customer.csv and the source files")
    run.add_argument("--list", action="store_true", help="list the stages")
    run.add_argument("--stage", action="append", help="a stage to run; give it several times for several stages")
    run.add_argument("--from", dest="start", help="first stage to run, with all that follow")
    run.add_argument("--strict", action="store_true", help="stop with an error at a gate that says BLOCKED")
    run.add_argument("--generate", action="store_true", help="write made-up sources to the data folder first")
    run.add_argument("--test", action="store_true", help="test the staged master rows at the end")
    run.add_argument("--dry-run", action="store_true", help="show what would run")
    run.add_argument("--dashboard", help="write the page here")
    steward = parts.add_parser("review", help="list reviews and decide")
    steward.add_argument("--list", action="store_true")
    steward.add_argument("--list-resolved", action="store_true")
    steward.add_argument("--import-actions", metavar="CSV")
    steward.add_argument("--restore-from-audit", action="store_true")
    steward.add_argument("--review-id")
    steward.add_argument("--source", metavar="SYSTEM:ID")
    choice = steward.add_mutually_exclusive_group()
    choice.add_argument("--approve", action="store_true")
    choice.add_argument("--reject", action="store_true")
    steward.add_argument("--golden-id")
    steward.add_argument("--by", default="DATA_STEWARD")
    steward.add_argument("--reason")
    tell = parts.add_parser("explain", help="all about one entity")
    tell.add_argument("golden_id")
    return top


def _run(spark, store: TableStore, a: argparse.Namespace) -> int:
    stages = trust.select_stages(a.stage, a.start, a.generate, a.test)
    if a.list or a.dry_run:
        print("\n".join([*trust.STAGES, *trust.OPT_IN] if a.list else stages))
        return 0
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    if a.data is None and {"generate", "staging", "contract"} & set(stages):
        print("--data is needed to generate, check or stage sources")
        return 1
    run = trust.Run(spark, store, now.strftime("RUN-%Y%m%d-%H%M%S"), now, None, {}, dashboard_path=a.dashboard, data=a.data)
    if a.data is not None:
        run.load()
    code = 0
    try:
        trust.execute(run, stages, a.strict)
    except trust.FreshStoreError as fresh:
        print(fresh)
        return 1
    except trust.GateBlocked as gate:
        print(f"stopped: {gate} is BLOCKED")
        code = 1
    except trust.StageFailed as failed:
        print(f"stage {failed} failed: {type(failed.__cause__).__name__}: {failed.__cause__}")
        code = 1
    for name, seconds in run.timings.items():
        print(f"{name:18s} {seconds:8.2f} s  {run.gates.get(name, '')}")
    left = [n for n in stages if n not in run.timings]
    if left:
        print(f"not run: {', '.join(left)}")
    if code == 0 and "test" in stages:
        for row in store.read("staging_test").orderBy("test_name").collect():  # a row for each test
            print(f"{row['test_name']:24s} {'passed' if row['failing'] == 0 else str(row['failing']) + ' failing'}")
    if code == 0 and "reporting" in stages:
        last = store.read("dq_run_trend").orderBy(F.desc("started_at"), F.desc("run_id")).first()
        for m in scoring.MEASURES:
            print(f"{m:20s} {last[f'{m}_trend']}")
        if last["gate_status_change"]:
            print(f"{'gate':20s} {last['gate_status_change']}")
    return code


def _review(spark, store: TableStore, a: argparse.Namespace) -> int:
    if a.list or a.list_resolved:
        store.read("review_queue").where(F.col("status") == ("RESOLVED" if a.list_resolved else "OPEN")).orderBy(F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2), "issue_type", "review_id").show(200, False)
    elif a.import_actions:
        given = staging.read_text_csv(spark, a.import_actions).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz"))
        store.overwrite("identity_resolution_action", review.import_actions(store.read("identity_resolution_action"), given))
    elif a.restore_from_audit:
        store.overwrite("review_queue", review.restore(store.read("review_queue"), store.read("identity_resolution_action")))
    else:
        if not a.reason or not (a.approve or a.reject) or not (a.review_id or a.source):
            print("a decision needs --review-id or --source, --approve or --reject, and --reason")
            return 2
        old = store.read("identity_resolution_action")
        queue, actions, note = review.resolve(store.read("review_queue"), old, store.read("golden_entity"), decision="APPROVED" if a.approve else "REJECTED", reason=a.reason, review_id=a.review_id, source=a.source, golden_id=a.golden_id, by=a.by, action_id=str(uuid.uuid4()))
        if actions is not old:
            store.overwrite("identity_resolution_action", actions.withColumn("created_at", F.coalesce("created_at", F.current_timestamp().cast("timestamp_ntz"))))
            store.overwrite("review_queue", queue)
        print(note or "done")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = get_spark("attesta")
    ship_code(spark)
    store = TableStore(spark, a.store, trust.SCHEMAS, trust.KEYS)
    if a.command == "run":
        return _run(spark, store, a)
    if a.command == "review":
        return _review(spark, store, a)
    print(lineage.explain(a.golden_id, store.read("golden_entity"), store.read("golden_entity_member"), store.read("identity_resolution_action"), store.read("golden_lineage"), store.read("dq_attribute_result")))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
