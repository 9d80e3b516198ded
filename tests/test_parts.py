import uuid

import pytest
from pyspark.sql import functions as F

from attesta.functions import expressions as E
from attesta.operators import golden, review, rules, scoring
from attesta.plans.components import connected_components
from attesta.sources import config, contract
from attesta.sources.store import ConstraintError, TableStore


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_uuid5_is_pythons(spark):
    for name in ("", "a|b|", "é漢", "review-case|GOLDEN_ENTITY|G000001"):
        assert one(spark, E.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_text_forms(spark):
    assert one(spark, E.folded(F.lit(" \t Ab　\n"))) == "ab" and one(spark, E.stripped(F.lit(" \t\n"))) is None
    dates = {"1977-08-19": True, "1977/08/19": True, "1977-8-9": True, "1977-08-19 10:00:00": True, "1977": False, "+1977-08-19": False, "19/08/1977": False, "1977-13-01": False, "x": False}
    for text, good in dates.items():
        assert (one(spark, E.strict_date(F.lit(text))) is not None) == good, text


def test_rule_dialect(spark):
    email = next(r for r in config.rules() if r.rule_id == "DQ-CUS-007")
    df = spark.createDataFrame([("a", "ok@b.co"), ("b", "axb"), ("c", "a@bxco"), ("d", "a@b.co\n"), ("e", None)], "customer_id string, email string")
    assert sorted(r.customer_id for r in rules.failing_rows(df, email).collect()) == ["b", "c", "d"]
    keys = next(r for r in config.rules() if r.rule_id == "DQ-CUS-002")
    twice = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "customer_id string")
    assert rules.run_rules(twice, [keys], "R").count() == 2


def test_null_key_is_quarantined_but_eligible(spark):
    df = spark.createDataFrame([(None, "1"), ("a", None), ("b", "2")], "customer_id string, nik string")
    registry = [config.Rule("R1", "stg_customer", "customer_id", None, None, "CRITICAL", "PASS_RATE", 100.0, "DRAFT", "customer_id IS NULL"), config.Rule("R2", "stg_customer", "nik", None, None, "LOW", "ODD", 1.0, None, "nik IS NULL")]
    frame = rules.rule_frame(spark, registry)
    results = rules.run_rules(df, registry, "R")
    bad = rules.quarantine(df, results, frame)
    assert sorted((r.customer_id, r.original_value) for r in bad.collect()) == [("None", None), ("a", None)]
    assert sorted(str(r.customer_id) for r in rules.eligible(df, bad, "R").collect()) == ["None", "b"] and rules.eligible(df, bad, None).count() == 0
    assert {r.rule_id: r.status for r in rules.summary(frame, results, 3).collect()} == {"R1": "FAIL", "R2": "UNKNOWN"}
    assert rules.summary(frame, results.limit(0), 0).first().pass_rate == 100.0
    assert rules.source_gate(results.where("rule_id = 'R2'"), frame).first().gate_status == "PASSED"


def test_contract_cases(spark):
    declared = [c for c in config.contracts() if c.file_name == "crm_customer.csv"]
    names = [c.column_name for c in declared]
    good = ("1", "n", "f", "p", "e", "1980-01-01")

    def check(rows, columns=names, contracts=declared):
        df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
        found = contract.check_frame(df, "crm_customer.csv", contracts)
        return sorted((r.violation_type, r.column_name, r.severity, r.violation_count, r.sample_value) for r in found.collect()), contract.gate(found)

    assert check([good]) == ([], "PASSED")
    assert check([(*good, "x")], [*names, "extra"]) == ([("NEW_COLUMN", "extra", "LOW", None, None)], "WARNING")
    assert check([good[:4] + good[5:]], names[:4] + names[5:]) == ([("MISSING_COLUMN", "email", "CRITICAL", None, None)], "BLOCKED")
    assert check([good], [n.upper() if n == "nik" else n for n in names])[1] == "BLOCKED"
    assert check([(*good[:5], "31/12/1980"), (*good[:5], "01/01/1980"), (*good[:5], " ")])[0] == [("TYPE_MISMATCH", "birth_date", "HIGH", 2, "01/01/1980")]
    assert check([(" ", *good[1:])])[0] == [("NULL_VIOLATION", "source_customer_id", "CRITICAL", 1, None)]
    drafts = [c for c in declared if c.column_name != "nik"]
    assert check([good], contracts=drafts)[0] == [("NEW_COLUMN", "nik", "LOW", None, None)]
    assert contract.gate(contract.check_frame(None, "crm_customer.csv", declared)) == "BLOCKED"


def test_configuration_fails_loudly(tmp_path):
    (tmp_path / "t.csv").write_text("scope,key,value,status,description\na,b,1,INACTIVE,\n")
    with pytest.raises(config.ConfigError):
        config.thresholds("a", tmp_path / "t.csv")
    (tmp_path / "s.csv").write_text("signal,score,status,description\nNIK_MATCH,1,ACTIVE,\n")
    with pytest.raises(config.ConfigError):
        config.signals(tmp_path / "s.csv")
    with pytest.raises(FileNotFoundError):
        config.contracts(tmp_path / "none.csv")


def test_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}", {"t": "k string, v int, w string"}, {"t": ["k"]})
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    get = lambda: sorted((r.k, r.v) for r in store.read("t").collect())
    assert get() == [] and not store.exists("t")
    store.overwrite("t", frame(("a", 1)))
    assert store.read("t").columns == ["k", "v", "w"] and store.read("t").first().w is None  # a column added later
    store.insert_absent("t", frame(("a", 2), ("b", 2)))
    assert get() == [("a", 1), ("b", 2)]
    store.upsert("t", frame(("a", 5), ("c", 6)))
    assert get() == [("a", 5), ("b", 2), ("c", 6)]
    store.upsert("t", frame(("a", 9), ("d", 7)), keep=["v"])
    assert get() == [("a", 5), ("b", 2), ("c", 6), ("d", 7)]
    for bad in (frame(("a", 1), ("a", 2)), frame((None, 1))):
        with pytest.raises(ConstraintError):
            store.overwrite("t", bad)
    assert len(get()) == 4
    for k in range(8):  # a run that dies before its pointer leaves the table as it was; old versions go
        store.overwrite("t", frame(("a", k)))
    frame(("z", 0)).write.parquet(f"file://{tmp_path}/t/v-unfinished")
    assert get() == [("a", 7)] and len(list((tmp_path / "t").glob("POINTER-*"))) == store.KEEP
    for run, v in (("R 1/x", 1), ("R2", 2), ("R 1/x", 3)):
        store.replace_run("h", frame(("k", v)).withColumn("run_id", F.lit(run)), run)
    assert sorted((r.run_id, r.v) for r in store.read("h").collect()) == [("R 1/x", 3), ("R2", 2)]


def test_history(spark):
    at = lambda d: F.lit(f"2026-01-0{d} 00:00:00").cast("timestamp_ntz")
    live = lambda *rows: spark.createDataFrame(rows, "k string, x string, y string")
    empty = live().withColumns({"valid_from": at(1), "valid_to": at(1), "is_current": F.lit(True), "change_reason": F.lit("")})
    h1 = golden.history(empty, live(("a", "1", None), ("b", "1", "1"), ("c", "1", "1")), ["k"], ["x", "y"], at(1), "INITIAL")
    h2 = golden.history(h1, live(("a", "1", None), ("b", "2", None), ("d", "1", "1")), ["k"], ["x", "y"], at(2), "INITIAL")
    got = sorted((r.k, r.x, r.y, r.valid_from.day, r.valid_to and r.valid_to.day, r.is_current, r.change_reason) for r in h2.collect())
    assert got == [("a", "1", None, 1, None, True, "INITIAL"), ("b", "1", "1", 1, 2, False, "INITIAL"), ("b", "2", None, 2, None, True, "CHANGED:x,y"), ("c", "1", "1", 1, 2, False, "INITIAL"), ("d", "1", "1", 2, None, True, "INITIAL")]


def test_decisions(spark):
    queue = spark.createDataFrame([("r1", "POSSIBLE_MATCH", None, "A", "1", None, "MEDIUM", "x", "OPEN"), ("r2", "POSSIBLE_MATCH", None, "B", "2", None, "MEDIUM", "x", "OPEN"), ("r3", "POSSIBLE_MATCH", None, "B", "2", None, "MEDIUM", "x", "OPEN")], ", ".join(f"{c} string" for c in review.QUEUE))
    actions = spark.createDataFrame([], "action_id string, review_id string, action_type string, source_system string, source_customer_id string, golden_id string, performed_by string, reason string")
    entities = spark.createDataFrame([("G1", "ACTIVE"), ("G2", "REVIEW")], "golden_id string, entity_status string")
    decide = lambda **k: review.resolve(queue, k.pop("actions", actions), entities, decision=k.pop("decision", "APPROVED"), reason="why", action_id="a", **k)
    q, a, note = decide(review_id="r1", golden_id="G2")
    assert "REVIEW" in note and a.count() == 1 and q.where("status = 'RESOLVED'").count() == 1
    assert decide(review_id="r1", golden_id="G2", actions=a)[2] == "decided already"
    assert decide(source="a:1", decision="REJECTED")[1].count() == 1
    for wrong in ({"source": "B:2", "golden_id": "G1"}, {"review_id": "r1", "golden_id": "G9"}, {"review_id": "r1"}, {"review_id": "none", "golden_id": "G1"}):
        with pytest.raises(review.ReviewError):
            decide(**wrong)
    assert review.import_actions(a, a).count() == 1
    back = review.restore(queue.where("review_id <> 'r1'"), a).where("review_id = 'r1'").first()
    assert back.status == "RESOLVED" and back.reason.startswith("[restored from audit] ")


def test_cases_close_and_reopen(spark):
    at = lambda d: F.lit(f"2026-01-0{d} 00:00:00").cast("timestamp_ntz")
    form = "case_id string, subject_type string, subject_key string, severity string, status string, evidence_count int, issue_types string, summary string"
    row = lambda i, s: (i, "REVIEW", i, "LOW", s, 1, "t", "s")
    empty = spark.createDataFrame([], form + ", opened_at timestamp_ntz, closed_at timestamp_ntz")
    a = review.upsert_cases(empty, spark.createDataFrame([row("x", "RESOLVED"), row("y", "OPEN")], form), at(1))
    b = review.upsert_cases(a, spark.createDataFrame([row("x", "OPEN")], form), at(2))
    got = {r.case_id: (r.status, r.evidence_count, r.opened_at.day, r.closed_at and r.closed_at.day) for r in b.collect()}
    assert got == {"x": ("OPEN", 1, 1, None), "y": ("RESOLVED", 0, 1, 2)}
    assert {r.case_id: r.status for r in review.upsert_cases(b, spark.createDataFrame([], form), at(3)).collect()} == {"x": "OPEN", "y": "RESOLVED"}


def test_arrows_and_weights(spark):
    cases = {(None, 1.0): "  -", (1.0, 1.04): "  =", (2.0, 1.0): "UP  +1.0", (1.0, 2.5): "DOWN -1.5"}
    for (a, b), want in cases.items():
        assert one(spark, scoring.arrow(F.lit(a).cast("double"), F.lit(b).cast("double"))) == want
    assert one(spark, scoring.arrow(F.lit(2.0), F.lit(5.0), higher_is_better=False)) == "UP  -3.0" and one(spark, scoring.arrow(F.lit(5.0), F.lit(2.0), higher_is_better=False)) == "DOWN +3.0"
    runs = spark.createDataFrame([("a", 1, 5, "BLOCKED"), ("b", 2, 2, "PASSED"), ("c", 3, 2, "PASSED")], "run_id string, started_at int, open_reviews int, gate_status string")
    assert [(r.open_reviews_trend, r.gate_status_change) for r in scoring.trend(runs, {"open_reviews": False}, states=("gate_status",)).orderBy("run_id").collect()] == [("  -", None), ("UP  -3.0", "BLOCKED -> PASSED"), ("  =", None)]
    dims = spark.createDataFrame([("a", 50.0, 0.25, ""), ("b", None, 0.5, ""), ("c", 100.0, 0.25, "")], "dimension string, score double, weight double, detail string")
    assert {r.dimension: r.contribution for r in scoring.overall(dims).collect()} == {"a": 25.0, "b": None, "c": 50.0}


def test_components(spark):
    import random

    rng = random.Random(1)
    path = list(range(40))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(100, 100), (200, 201), (201, 200), (None, 3)] + [(300, 300 + k) for k in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), in_one_task=1000).collect()}
    pairs = spark.createDataFrame([("x", "1", "a", "2"), ("b", "9", "a", "2")], "s1 string, k1 string, s2 string, k2 string").selectExpr("struct(s1 as s, k1 as k) as a", "struct(s2 as s, k2 as k) as b")
    assert {tuple(r.component) for r in connected_components(pairs, in_one_task=9).collect()} == {("a", "2")}
    assert got == {**{k: 0 for k in range(40)}, 100: 100, 200: 200, 201: 200, **{300 + k: 300 for k in range(50)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
