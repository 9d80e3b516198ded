"""The whole pipeline on small data, against published figures; run again; after a steward's approval."""

import datetime
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import people

from attesta import trust
from attesta.operators import identity, review
from attesta.reporting import lineage
from attesta.sources.store import TableStore

T1, T2, T3 = (datetime.datetime(2026, 9, 2, 0, k) for k in (1, 2, 3))


def go(spark, store, now, stages=None, tmp=None):
    run = trust.Run(spark, store, now.strftime("RUN-%Y%m%d-%H%M%S"), now, people.master(spark), people.sources(spark), dashboard_path=tmp and str(tmp / "page.html"))
    return trust.execute(run, stages or trust.select_stages())


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("store")
    store = TableStore(spark, f"file://{tmp}/tables", trust.SCHEMAS, trust.KEYS)
    return store, go(spark, store, T1, tmp=tmp), tmp


def test_first_run(done):
    store, run, tmp = done
    read = store.read
    summary = {r.rule_id: (r.failed_records, r.status) for r in read("dq_summary").collect()}
    assert [summary[f"DQ-CUS-{k:03d}"][0] for k in range(1, 9)] == [0, 0, 1, 0, 2, 1, 0, 1]
    assert [summary[f"DQ-CUS-{k:03d}"][1] for k in range(1, 9)] == ["PASS", "PASS", "FAIL", "PASS", "FAIL", "PASS", "PASS", "FAIL"]
    assert read("quarantine_customer").select("customer_id").distinct().count() == 5 and read("eligible_customer").count() == 995
    m = read("identity_metrics").first()
    assert (m.total_pairs, m.confirmed_records, m.review_records, m.unresolved_records, m.golden_entity_count, m.avg_cluster_size) == (12, 8, 3, 4, 4, 2.75)
    assert m.resolution_health == pytest.approx(55.0)
    assert sorted(r.golden_id for r in read("golden_entity").collect()) == ["G000001", "G000002", "G000003", "G000004"]
    quality = [(r.quality_status, r.quality_score) for r in read("golden_quality_score").collect()]
    assert sorted(quality, key=str) == [("EXCELLENT", 100.0)] * 3 + [("NOT_ASSESSED", None)]
    status = [r.consistency_status for r in read("cross_source_consistency").collect()]
    assert (len(status), status.count("CONFLICT"), status.count("VARIATION")) == (20, 1, 3)
    queue = [r.severity for r in read("review_queue").collect()]
    assert (queue.count("HIGH"), queue.count("MEDIUM")) == (3, 2)
    assert sorted((r.severity, r.evidence_count) for r in read("review_case").collect()) == [("HIGH", 3), ("MEDIUM", 2)]
    dims = {r.dimension: r.score for r in read("cdp_quality_dimension").collect()}
    assert dims == pytest.approx({"source_dq": 99.5, "identity": 55.0, "golden_quality": 100.0, "consistency": 95.0, "review_health": 45.0})
    score = read("cdp_quality_score").first()
    assert score.overall_score == pytest.approx(84.375) and score.overall_status == "WARNING"
    gate = read("cdp_quality_gate").first()
    assert gate.gate_status == "BLOCKED" and "DQ-CUS-003 (1 record(s))" in gate.blocking_reasons and run.gates["source_gate"] == "BLOCKED"
    by = {(r.golden_id, r.attribute_name): r.source_system for r in read("golden_customer_attribute").collect()}
    assert by["G000001", "phone"] == "MOBILE" and by["G000001", "birth_date"] == "LOS" and by["G000001", "nik"] == "CRM" and len(by) == 15
    page = (tmp / "page.html").read_text()
    assert "84.4" in page and "BLOCKED" in page
    text = lineage.explain("G000001", read("golden_entity"), read("golden_entity_member"), read("identity_resolution_action"), read("golden_lineage"), read("dq_attribute_result"))
    assert "phone = 081100000001  from MOBILE:MOB001" in text and "NULL_OR_EMPTY" in text


def test_rerun_and_approval(done, spark):
    store, _, _ = done
    before = {t: sorted(map(str, store.read(t).collect())) for t in ("golden_entity_member", "golden_customer_history", "golden_entity_member_history", "review_queue", "golden_entity_identity")}
    go(spark, store, T2)
    assert before == {t: sorted(map(str, store.read(t).collect())) for t in before}
    assert store.read("dq_run_history").count() == 2 and store.read("dq_summary").count() == 16 and store.read("dq_result").select("run_id").distinct().count() == 2
    last = store.read("dq_run_trend").orderBy("started_at").collect()
    assert last[0].overall_score_trend == "  -" and last[1].overall_score_trend == "  =" and last[1].gate_status_change is None

    queue, actions, note = review.resolve(store.read("review_queue").where("source_system = 'CRM'"), store.read("identity_resolution_action"), store.read("golden_entity"), decision="APPROVED", reason="seen", source="crm:CRM002", golden_id="G000002", action_id="a1")
    assert note == "" and queue.where("status = 'RESOLVED'").count() == 1
    member = store.read("review_queue").where("source_customer_id = 'CRM002'").first()
    actions = spark.createDataFrame([("a1", member.review_id, "APPROVED", "MOBILE", "MOB002", "G000002", "STEWARD", "seen", T2)], trust.SCHEMAS["identity_resolution_action"])
    store.overwrite("identity_resolution_action", actions)
    go(spark, store, T3, trust.select_stages(start="identity"))
    m = store.read("identity_metrics").first()
    assert (m.confirmed_records, m.review_records, m.unresolved_records) == (9, 3, 3) and m.resolution_health == pytest.approx(61.667, abs=1e-3)
    assert store.read("golden_entity_member").where("golden_id = 'G000002'").count() == 3
    assert store.read("cdp_quality_score").first().overall_score == pytest.approx(86.708, abs=1e-3)
    assert store.read("review_queue").where("status = 'OPEN'").count() == 3
    added = store.read("golden_entity_member_history").where("source_customer_id = 'MOB002'").first()
    assert added.change_reason == "MEMBER_ADDED" and added.valid_from == T3
    changed = [r.change_reason for r in store.read("golden_customer_history").where("golden_id = 'G000002' and is_current").collect()]
    assert changed == ["INITIAL"] or changed[0].startswith("CHANGED:")
    assert store.read("golden_lineage").where("resolution_action = 'APPROVED'").count() > 0


def one_by_one(found, registry, previous):
    """The rule for ids, cluster by cluster: members -> id."""
    top, claimed, out = max([int(g[1:]) for g, _, _ in registry if g[1:].isdigit()], default=0), set(), {}
    active = {g for g, _, a in registry if a}
    for members in sorted(found):
        same = min((g for g, s, _ in registry if s == "|".join(members)), default=None)
        shared = {}
        for m, g in previous:
            if m in members and g in active and g not in claimed:
                shared[g] = shared.get(g, 0) + 1
        if same is not None and same not in claimed:
            out[members] = same
        elif shared:
            out[members] = min(shared, key=lambda g: (-shared[g], g))
        else:
            top += 1
            out[members] = f"G{top:06d}"
        claimed.add(out[members])
    return out


def given_ids(spark, found, registry, previous):
    shapes = spark.createDataFrame([(f"c{k}", list(m), False, "|".join(m)) for k, m in enumerate(found)], "cluster string, members array<string>, has_conflict boolean, cluster_signature string")
    known = spark.createDataFrame(registry, trust.SCHEMAS["golden_entity_identity"])
    rows = spark.createDataFrame([(g, "S", m.split("::")[1]) for m, g in previous], "golden_id string, source_system string, source_customer_id string")
    out = identity.persistent_ids(shapes, known, rows)
    assert out.columns == [*shapes.columns, "golden_id"] and out.where(F.col("golden_id").isNull()).isEmpty()
    return {tuple(r.members): r.golden_id for r in out.collect()}


def test_registry_rules(spark):
    m = lambda *names: tuple(f"S::{n}" for n in names)
    sign = "|".join
    own = lambda g, *names: [(x, g) for x in m(*names)]
    cases = [
        ([m("a", "b"), m("c", "d")], [], []),
        ([m("x", "y")], [("G000007", "old", False)], []),  # numbers are never given twice
        ([m("a", "b")], [("G000003", sign(m("a", "b")), False)], []),
        ([m("a", "b", "c")], [("G000001", sign(m("a", "b")), True)], own("G000001", "a", "b")),
        ([m("a", "b"), m("c", "d")], [("G000001", sign(m("a", "b", "c", "d")), True)], own("G000001", "a", "b", "c", "d")),
        # an earlier cluster's overlap may take the id that a later one has by signature
        ([m("a", "c"), m("b", "d")], [("G000001", sign(m("b", "d")), True)], own("G000001", "a", "b", "d")),
        # of several ids with a signature only the lowest counts
        ([m("a", "c"), m("b", "d")], [("G000001", sign(m("b", "d")), True), ("G000002", sign(m("b", "d")), True)], own("G000001", "a") + own("G000002", "x")),
        ([m("a", "b"), m("p", "q")], [("G1999999", "old", True), ("G000004", sign(m("p", "q")), True)], own("G000004", "p", "q")),  # seven digits are not cut
    ]
    for found, registry, previous in cases:
        assert given_ids(spark, found, registry, previous) == one_by_one(found, registry, previous)
    assert given_ids(spark, *cases[-1])[m("a", "b")] == "G2000000"


def test_registry_rules_at_random(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        deal = lambda n: [tuple(sorted(g)) for g in {k: [f"S::{i:03d}" for i in range(80) if (i * 7 + rng.randrange(2)) % n == k] for k in range(n)}.values() if len(g) > 1]
        before, found = deal(17), deal(17) + [("S::900", "S::901")]
        registry = [(f"G{k + 1:06d}", "|".join(g), rng.random() < 0.8) for k, g in enumerate(before)]
        found[0] = before[3] if not set(before[3]) & {x for f in found[1:] for x in f} else found[0]
        previous = [(x, f"G{k + 1:06d}") for k, g in enumerate(before) for x in g]
        assert given_ids(spark, found, registry, previous) == one_by_one(found, registry, previous)


def test_registry_is_bootstrapped(spark):
    entities = spark.createDataFrame([("G000009", "CUSTOMER", "ACTIVE", False, "HIGH")], trust.SCHEMAS["golden_entity"])
    members = spark.createDataFrame([("G000009", s, k, "CONFIRMED", "HIGH") for s, k in (("B", "2"), ("A", "1"))] + [("G000010", "A", "7", "CONFIRMED", "HIGH")], trust.SCHEMAS["golden_entity_member"])
    empty = spark.createDataFrame([], trust.SCHEMAS["golden_entity_identity"])
    made = identity.bootstrap(empty, entities, members).collect()
    shape = identity.entity_shapes(spark.createDataFrame([("A", "1", "c"), ("B", "2", "c")], "source_system string, source_customer_id string, cluster string"), spark.createDataFrame([], "match_status string, source_system string, source_customer_id string, candidate_source_system string, candidate_source_customer_id string")).first()
    assert [(r.golden_id, r.cluster_signature, r.is_active) for r in made] == [("G000009", shape.cluster_signature, True)]
    assert identity.bootstrap(spark.createDataFrame(made, empty.schema), entities.limit(0), members).count() == 1


def test_attachment_follows_the_order():
    import pyarrow as pa

    def run(clusters, pairs):
        group = lambda g: [(g, m + g, c + g, None, None) for m, c in clusters.items()] + [(g, None, None, a + g, b + g) for a, b in pairs]
        rows = pa.table(dict(zip(["grp", "member", "cluster", "left", "right"], zip(*group(""), *group("1")))))
        out = dict(kv for batch in identity._attach_groups(iter(rows.to_batches(max_chunksize=2))) for kv in zip(*(batch.column(c).to_pylist() for c in (0, 1))))
        assert {m[:-1]: c[:-1] for m, c in out.items() if m.endswith("1")} == {m: c for m, c in out.items() if not m.endswith("1")}
        return {m: c for m, c in out.items() if not m.endswith("1")}

    base = {"a": "A", "b": "A", "s": "s", "t": "t"}
    assert run(base, [("a", "s")])["s"] == "A"
    assert run(base, [("s", "t")]) == base  # two single records stay apart
    assert run(base, [("a", "s"), ("s", "t")])["t"] == "A"  # sizes change as it goes
    assert run(base, [("b", "t"), ("a", "t")])["t"] == "A"
    assert run({"a": "A", "b": "A", "c": "C", "d": "C"}, [("a", "c")])["c"] == "C"


def test_stage_selection():
    assert trust.select_stages(only=["scoring", "identity"]) == ["scoring", "identity"]
    assert trust.select_stages(start="scoring")[0] == "scoring" and len(trust.select_stages()) == 13
    assert trust.select_stages(only=["review"], generate=True, test=True) == ["review"] and trust.select_stages(start="test") == ["test"]
    assert trust.select_stages(start="dashboard", generate=True, test=True) == ["generate", "dashboard", "test"]
    with pytest.raises(KeyError):
        trust.select_stages(start="nowhere")


def test_fresh_store_and_failing_stage(spark, tmp_path, monkeypatch):
    store = TableStore(spark, f"file://{tmp_path}", trust.SCHEMAS, trust.KEYS)
    with pytest.raises(trust.FreshStoreError):
        go(spark, store, T1, ["identity"])

    def broken(run):
        raise KeyError("x")

    monkeypatch.setitem(trust.STAGES, "staging", broken)
    with pytest.raises(trust.StageFailed) as failed:
        go(spark, store, T1, ["staging", "source_dq"])
    assert isinstance(failed.value.__cause__, KeyError)


def test_contract_runs_are_kept(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}", trust.SCHEMAS, trust.KEYS)
    names = ["source_customer_id", "nik", "full_name", "phone", "email", "birth_date"]
    good = spark.createDataFrame([("1", "n", "f", "p", "e", "1980-01-01")], ", ".join(f"{n} string" for n in names))
    for k, (frame, want) in enumerate([(good, "PASSED"), (None, "BLOCKED"), (good.withColumn("more", good.nik), "WARNING")]):
        run = trust.Run(spark, store, f"R{k}", T1, None, {}, {"crm_customer.csv": frame})
        trust.execute(run, ["contract"])
        assert run.gates["contract"] == want
    assert [(r.run_id, r.contract_status, r.total_violations) for r in store.read("contract_run").orderBy("run_id").collect()] == [("R0", "PASSED", 0), ("R1", "BLOCKED", 1), ("R2", "WARNING", 1)]
    assert store.read("contract_violation").count() == 2


def test_made_up_sources(spark, tmp_path, capsys):
    from attesta import cli
    from attesta.sources import generate

    data, copy = f"file://{tmp_path}/data", f"file://{tmp_path}/copy"
    (tmp_path / "data").mkdir()
    store = TableStore(spark, f"file://{tmp_path}/store", trust.SCHEMAS, trust.KEYS)
    args = cli._parser().parse_args(["--store", store.root, "run", "--data", data, "--generate", "--test", "--stage", "generate", "--stage", "contract", "--stage", "staging", "--stage", "source_dq", "--stage", "identity", "--stage", "test"])
    assert cli._run(spark, store, args) == 0
    said = capsys.readouterr().out
    assert "contract" in said and "PASSED" in said and "unique_nik" in said
    failing = {r.test_name: r.failing for r in store.read("staging_test").collect()}
    assert failing["not_null_nik"] == 1 and failing["valid_phone"] == 1 and failing["valid_birth_date"] == 1 and failing["unique_nik"] == 1 and failing["unique_customer_id"] == 0
    status = [r.match_status for r in store.read("identity_match").collect()]
    assert status.count("CONFLICT") >= 1 and status.count("MATCH") >= 4 and store.read("golden_entity").count() == 4
    assert generate.sync_seeds(spark, data, copy) == ["customer.csv", *cli.staging.SYSTEMS.values()] and generate.sync_seeds(spark, f"{data}/none", copy) == []
    assert [spark.range(1).select(generate.cleaned(F.lit(v))).first()[0] for v in (" 12.0 ", " ", "a.0", None)] == ["12", None, "a.0", None]
