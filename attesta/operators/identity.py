"""Identity resolution: candidate pairs, decisions, ranking, clusters, entities with persistent ids, metrics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions.expressions import folded, percent, signature
from attesta.plans.components import connected_components
from attesta.session import materialise

RECORD = ["source_system", "source_customer_id"]
CANDIDATE = ["candidate_source_system", "candidate_source_customer_id"]
KEYS = ["nik", "phone", "email"]
#: Graphs of at most so many edges (two texts each) are solved by one task.
SMALL_GRAPH = 200_000


def candidates(unified: DataFrame, signals: dict[str, int]) -> DataFrame:
    """Pairs of records of different systems that agree on nik, phone or email, with flags and score.

    Three equi-joins on the non-null normalised keys; a pair is kept by the first key it agrees on,
    so no second pass is needed to make pairs unique. Each input row is a record of its own.
    """
    norm = unified.select(*RECORD, *[folded(c).alias(c) for c in KEYS], folded(F.col("birth_date").cast("string")).alias("dob"))
    left = norm.select(*[F.col(c).alias(f"l_{c}") for c in norm.columns])
    right = norm.select(*[F.col(c).alias(f"r_{c}") for c in norm.columns])
    equal = {c: F.col(f"l_{c}") == F.col(f"r_{c}") for c in [*KEYS, "dob"]}
    found, earlier = None, []
    for key in KEYS:
        on = equal[key] & (F.col("l_source_system") < F.col("r_source_system"))
        for done in earlier:
            on = on & ~F.coalesce(equal[done], F.lit(False))
        pairs = left.where(f"l_{key} is not null").join(right.where(f"r_{key} is not null"), on)
        found = pairs if found is None else found.unionByName(pairs)
        earlier.append(key)
    match = {c: F.coalesce(equal[c], F.lit(False)) for c in equal}
    clash = {c: F.coalesce(~equal[c], F.lit(False)) for c in ("dob", "phone", "email")}
    score = sum((F.when(match[c], signals[f"{c.upper()}_MATCH"]).otherwise(0) for c in ("nik", "dob", "phone", "email")), F.lit(0))
    score = score + sum((F.when(clash[c], signals[f"{c.upper()}_CONFLICT"]).otherwise(0) for c in clash), F.lit(0))
    return found.select(
        F.col("l_source_system").alias("source_system"), F.col("l_source_customer_id").alias("source_customer_id"), F.col("r_source_system").alias("candidate_source_system"), F.col("r_source_customer_id").alias("candidate_source_customer_id"),
        *[match[c].alias(f"{c}_match") for c in ("nik", "dob", "phone", "email")], *[clash[c].alias(f"{c}_conflict") for c in ("dob", "phone", "email")], score.cast("double").alias("match_score"),
    )


def decide(pairs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Adds match_status, matched_on and reason. A conflict beside equal ids comes before any score."""
    conflict = F.col("dob_conflict") | F.col("phone_conflict") | F.col("email_conflict")
    support = sum((F.col(f"{c}_match").cast("int") for c in ("dob", "phone", "email")), F.lit(0))
    status = (
        F.when(F.col("nik_match") & conflict, "CONFLICT")
        .when(F.col("nik_match") & (F.col("match_score") >= limits["match_min_score"]), "MATCH")
        .when((support >= limits["possible_match_min_signals"]) & ~conflict, "POSSIBLE_MATCH")
        .when((F.col("match_score") >= limits["possible_match_min_score"]) & ~conflict, "POSSIBLE_MATCH")
        .otherwise("NO_MATCH")
    )
    on = F.concat_ws(",", *[F.when(F.col(f"{c}_match"), c.upper()) for c in ("nik", "dob", "phone", "email")], *[F.when(F.col(f"{c}_conflict"), f"CONFLICT:{c.upper()}") for c in ("dob", "phone", "email")])
    return pairs.withColumn("match_status", status).withColumn("matched_on", on).withColumn("reason", F.concat(F.lit("Candidate score="), F.col("match_score").cast("string"), F.lit("; signals="), F.col("matched_on")))


def rank(matches: DataFrame) -> DataFrame:
    """For each left-hand record its best pair, the gap to the second, confidence and status; ties by the candidate's key."""
    by = Window.partitionBy(*RECORD)
    order = by.orderBy(F.desc("match_score"), *CANDIDATE)
    conflict = F.col("dob_conflict") | F.col("phone_conflict") | F.col("email_conflict")
    top = matches.withColumn("place", F.row_number().over(order)).withColumn("second_score", F.lead("match_score").over(order)).withColumn("conflict_count", F.count(F.when(conflict, 1)).over(by)).withColumn("candidate_count", F.count("*").over(by)).where("place = 1")
    gap = F.col("match_score") - F.coalesce("second_score", F.lit(0.0))
    out = top.withColumn("score_gap", gap)
    clean = F.col("conflict_count") == 0
    out = out.withColumn("confidence", F.when((F.col("match_score") >= 150) & (F.col("score_gap") >= 30) & clean, "HIGH").when((F.col("match_score") >= 100) & (F.col("score_gap") >= 20), "MEDIUM").otherwise("LOW"))
    status = F.when(~clean & (F.col("match_score") >= 100), "MATCH_WITH_CONFLICT").when((F.col("match_status") == "MATCH") & (F.col("confidence") == "HIGH"), "MATCH").when(F.col("match_score") >= 60, "POSSIBLE_MATCH").otherwise("NO_MATCH")
    return out.select(*RECORD, *[F.col(c).alias(c.replace("candidate_", "best_")) for c in CANDIDATE], F.col("match_score").alias("best_score"), "second_score", "score_gap", "candidate_count", "conflict_count", "confidence", status.alias("resolution_status"))


def node(system: str, key: str) -> Column:
    """A record as one value that sorts like (system, key)."""
    return F.struct(F.col(system).alias("s"), F.col(key).alias("k"))


def _name(record: Column) -> Column:
    return F.concat(record["s"], F.lit("::"), record["k"])


def trusted_edges(matches: DataFrame, least: float) -> DataFrame:
    return matches.where((F.col("match_status") == "MATCH") & (F.col("match_score") >= least)).select(node(*RECORD).alias("a"), node(*CANDIDATE).alias("b"))


def steward_edges(actions: DataFrame, previous: DataFrame, unified: DataFrame) -> DataFrame:
    """Approved records and the previous members of the entity they were approved for, as far as the sources still have them: a star for each entity."""
    approved = actions.where("action_type = 'APPROVED'").select("golden_id", *RECORD)
    named = approved.unionByName(previous.select("golden_id", *RECORD).join(approved.select("golden_id").distinct(), "golden_id", "left_semi")).distinct()
    alive = named.join(unified.select(*RECORD).distinct(), RECORD, "left_semi").select("golden_id", node(*RECORD).alias("b"))
    return alive.join(alive.groupBy("golden_id").agg(F.min("b").alias("a")), "golden_id").where("a <> b").select("a", "b")


def attach(home: dict[str, str], pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The greedy rule for one connected group of clusters and conflicts: member -> cluster, after its conflict pairs in their order.

    A conflict between a record on its own and a cluster of two or more moves the record into the
    cluster; sizes change as it goes. Two single records, or two clusters, stay apart.
    """
    size: dict[str, int] = {}
    for c in home.values():
        size[c] = size.get(c, 0) + 1
    for a, b in pairs:
        if home[a] == home[b]:
            continue
        if size[home[a]] >= 2 and size[home[b]] == 1:
            a, b = b, a
        if size[home[a]] == 1 and size[home[b]] >= 2:
            size[home[a]] -= 1
            size[home[b]] += 1
            home[a] = home[b]
    return home


def _attach_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, member, cluster, left, right), a group's together and its pairs in order -> (member, cluster); a group is held at a time."""

    def moved(home: dict[str, str], pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        out = attach(home, pairs)
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.string())], names=["member", "cluster"])

    last, home, pairs, done = None, {}, [], {}
    for batch in batches:
        for grp, member, cluster, left, right in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if grp != last and last is not None:
                done.update(attach(home, pairs))
                home, pairs = {}, []
                if len(done) > 10_000:
                    yield moved(done, [])
                    done = {}
            last = grp
            if member is not None:
                home[member] = cluster
            else:
                pairs.append((left, right))
    if last is not None:
        done.update(attach(home, pairs))
    if done:
        yield moved(done, [])


def clusters(unified: DataFrame, matches: DataFrame, least: float, steward: DataFrame | None = None) -> DataFrame:
    """(source_system, source_customer_id, cluster) of every record in a cluster of two or more.

    Connected components over trusted and steward edges, then the order-dependent attachment of
    conflicting single records. Groups that no conflict joins cannot influence each other, so each
    connected group of clusters and conflicts runs the exact loop on its own.
    """
    edges = trusted_edges(matches, least)
    if steward is not None:
        edges = edges.unionByName(steward)
    present = unified.select(node(*RECORD).alias("node")).distinct()
    comp = connected_components(edges, in_one_task=SMALL_GRAPH)
    conflicts = materialise(matches.where(F.col("match_status").isin("CONFLICT", "MATCH_WITH_CONFLICT")).select(node(*RECORD).alias("a"), node(*CANDIDATE).alias("b")).distinct(), "conflicts")
    groups = connected_components(edges.unionByName(conflicts), in_one_task=SMALL_GRAPH)
    placed = present.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    touched = conflicts.select(F.explode(F.array("a", "b")).alias("node")).join(groups, "node").select("component").distinct()
    active = groups.join(touched, "component", "left_semi").withColumnRenamed("component", "grp")
    inside = placed.join(active, "node").select(_name(F.col("grp")).alias("grp"), _name(F.col("node")).alias("member"), _name(F.col("cluster")).alias("cluster"))
    pair_rows = conflicts.join(active.withColumnRenamed("node", "a"), "a").select(_name(F.col("grp")).alias("grp"), _name(F.col("a")).alias("left"), _name(F.col("b")).alias("right"), F.col("a.k").alias("left_key"), F.col("b.k").alias("right_key"))
    rows = inside.unionByName(pair_rows, allowMissingColumns=True)
    ordered = rows.repartition("grp").sortWithinPartitions("grp", "left_key", "right_key", "left", "right")
    moved = ordered.select("grp", "member", "cluster", "left", "right").mapInArrow(_attach_groups, "member string, cluster string")
    named = placed.join(active, "node", "left_anti").select(_name(F.col("node")).alias("member"), _name(F.col("cluster")).alias("cluster")).unionByName(moved)
    kept = named.join(named.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster"), "cluster")
    return kept.select(F.substring_index("member", "::", 1).alias("source_system"), F.expr("substring(member, instr(member, '::') + 2)").alias("source_customer_id"), "cluster")


def entity_shapes(clustered: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per cluster: members (sorted), signature, has_conflict (a member is in any conflict pair, with an outsider too)."""
    pairs = matches.where(F.col("match_status").isin("CONFLICT", "MATCH_WITH_CONFLICT"))
    torn = pairs.select(*RECORD).union(pairs.select(*CANDIDATE)).distinct().withColumn("torn", F.lit(True))
    rows = clustered.join(torn, RECORD, "left").withColumn("key", F.concat_ws("::", *RECORD))
    out = rows.groupBy("cluster").agg(F.array_sort(F.collect_set("key")).alias("members"), F.coalesce(F.max("torn"), F.lit(False)).alias("has_conflict"))
    return out.withColumn("cluster_signature", signature(F.col("members")))


def fresh_ids(shapes: DataFrame, after: int = 0) -> DataFrame:
    """Adds golden_id: G and at least six digits by the order of the sorted member lists, from ``after`` + 1 on.

    Numbers are given by partition sums over a range partitioning, so no task sorts all entities.
    """
    ordered = shapes.select("cluster", "members").repartitionByRange("members").sortWithinPartitions("members").select("cluster", "members", F.spark_partition_id().alias("part"))
    ordered = materialise(ordered, "entity-order")
    place = F.row_number().over(Window.partitionBy("part").orderBy("members"))
    base = ordered.groupBy("part").agg(F.count("*").alias("n")).selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    number = (F.col("base") + F.col("place") + after).cast("long")
    numbered = ordered.withColumn("place", place).join(F.broadcast(base), "part").select("cluster", F.format_string("G%06d", number).alias("golden_id"))
    return shapes.join(numbered, "cluster").select(*shapes.columns, "golden_id")


def bootstrap(registry: DataFrame, entities: DataFrame, previous: DataFrame) -> DataFrame:
    """The id registry; where it is empty, the ids and members of entities that were made before there was one."""
    if not registry.isEmpty():
        return registry
    known = previous.join(entities.select("golden_id").distinct(), "golden_id", "left_semi").select("golden_id", F.concat_ws("::", *RECORD).alias("m"))
    made = known.groupBy("golden_id").agg(signature(F.array_sort(F.collect_set("m"))).alias("cluster_signature")).withColumn("is_active", F.lit(True))
    return registry.unionByName(made)


def _claim(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule for clusters that compete for ids, in the order of their member lists; no id: a new one."""
    claimed: set[str] = set()
    out = []
    for members, sign, same, shares in sorted(zip(map(list, pdf["members"]), pdf["cluster_signature"], pdf["same"], pdf["shares"]), key=lambda r: r[0]):
        given = None
        if same is not None and same not in claimed:
            given = same
        else:
            left = [(-s["shared"], s["golden_id"]) for s in (shares if shares is not None else []) if s["golden_id"] not in claimed]
            given = min(left)[1] if left else None
        if given is not None:
            claimed.add(given)
        out.append((sign, given))
    return pd.DataFrame(out, columns=["cluster_signature", "golden_id"], dtype=object)


def persistent_ids(shapes: DataFrame, registry: DataFrame, previous: DataFrame) -> DataFrame:
    """Adds golden_id to clusters, with the registry's ids kept; an empty registry numbers afresh.

    The rule goes through the clusters in the order of their member lists. A cluster takes (a) the
    lowest id with its signature, retired ones included, unless it is claimed, (b) the unclaimed
    active id whose previous members it shares most (ties: the lowest), (c) the next number never
    given. Clusters can only get in each other's way if ids that they could claim connect them, so:
    a cluster whose signature's id no other can reach keeps it by a join; connected groups of the
    others run the rule on their own; new numbers are given by partition sums. Nothing is collected.
    """
    if registry.isEmpty():
        return fresh_ids(shapes)
    same = registry.groupBy("cluster_signature").agg(F.min("golden_id").alias("same"))
    homes = previous.join(registry.where("is_active").select("golden_id"), "golden_id", "left_semi").select("golden_id", F.concat_ws("::", *RECORD).alias("m")).distinct()
    shared = shapes.select("cluster_signature", F.explode("members").alias("m")).join(homes, "m").groupBy("cluster_signature", "golden_id").agg(F.count("*").alias("shared"))
    overlaps = shared.groupBy("cluster_signature").agg(F.collect_list(F.struct("golden_id", "shared")).alias("shares"))
    claims = materialise(shapes.select("cluster_signature", "members").join(same, "cluster_signature", "left").join(overlaps, "cluster_signature", "left"), "id-claims")
    wanted = claims.select("cluster_signature", F.col("same").alias("golden_id")).where("golden_id is not null").unionByName(claims.select("cluster_signature", F.explode("shares.golden_id").alias("golden_id"))).distinct()
    reach = wanted.groupBy("golden_id").agg(F.count("*").alias("clusters"))
    plain = claims.join(reach.where("clusters = 1").select(F.col("golden_id").alias("same")), "same", "left_semi").select("cluster_signature", F.col("same").alias("golden_id"))
    rest = claims.where("same is not null or shares is not null").join(plain.select("cluster_signature"), "cluster_signature", "left_anti")
    edges = wanted.join(rest.select("cluster_signature"), "cluster_signature", "left_semi").select(F.concat(F.lit("c"), "cluster_signature").alias("a"), F.concat(F.lit("i"), "golden_id").alias("b"))
    groups = connected_components(edges, in_one_task=SMALL_GRAPH).select(F.expr("substring(node, 2)").alias("cluster_signature"), "component")
    ruled = rest.join(groups, "cluster_signature").groupBy("component").applyInPandas(_claim, "cluster_signature string, golden_id string")
    given = materialise(plain.unionByName(ruled.where("golden_id is not null")), "ids-kept")
    top = registry.where(F.col("golden_id").rlike("^G[0-9]+$")).agg(F.max(F.expr("cast(substring(golden_id, 2) as bigint)"))).first()[0] or 0
    new = fresh_ids(shapes.join(given.select("cluster_signature"), "cluster_signature", "left_anti"), top)
    return shapes.join(given, "cluster_signature").select(*shapes.columns, "golden_id").unionByName(new)


def entities(identified: DataFrame) -> DataFrame:
    """golden_entity rows."""
    torn = F.col("has_conflict")
    return identified.select("golden_id", F.lit("CUSTOMER").alias("entity_type"), F.when(torn, "REVIEW").otherwise("ACTIVE").alias("entity_status"), "has_conflict", F.when(torn, "MEDIUM").otherwise("HIGH").alias("confidence"))


def members(identified: DataFrame) -> DataFrame:
    """golden_entity_member rows."""
    torn = F.col("has_conflict")
    rows = identified.select("golden_id", "has_conflict", F.explode("members").alias("m"))
    return rows.select("golden_id", F.substring_index("m", "::", 1).alias("source_system"), F.expr("substring(m, instr(m, '::') + 2)").alias("source_customer_id"), F.when(torn, "REVIEW").otherwise("CONFIRMED").alias("membership_status"), F.when(torn, "MEDIUM").otherwise("HIGH").alias("membership_confidence"))


def registry_after(registry: DataFrame, identified: DataFrame) -> DataFrame:
    """The id registry after a run: this run's ids active with their signatures, others retired (only if there is any cluster), none deleted."""
    new = identified.select("golden_id", F.col("cluster_signature").alias("new_signature"))
    any_ = not new.isEmpty()
    both = registry.join(new, "golden_id", "full_outer")
    return both.select("golden_id", F.coalesce("new_signature", "cluster_signature").alias("cluster_signature"), F.when(F.col("new_signature").isNotNull(), True).when(F.lit(any_), False).otherwise(F.col("is_active")).alias("is_active"))


def unresolved(unified: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Records in no entity."""
    return unified.join(member_rows.select(*RECORD), RECORD, "left_anti")


def metrics(unified: DataFrame, matches: DataFrame, member_rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row of identity metrics; rates are null where there is nothing to divide by."""
    is_ = lambda *s: F.count(F.when(F.col("match_status").isin(*s), 1))
    pairs = matches.agg(F.count("*").alias("total_pairs"), is_("MATCH").alias("m"), is_("POSSIBLE_MATCH").alias("p"), is_("CONFLICT", "MATCH_WITH_CONFLICT").alias("c"))
    own = unified.select(*RECORD).join(member_rows.select(*RECORD, "membership_status"), RECORD, "left")
    records = own.agg(F.count("*").alias("total_source_records"), F.count(F.when(F.col("membership_status") == "CONFIRMED", 1)).alias("confirmed_records"), F.count(F.when(F.col("membership_status") == "REVIEW", 1)).alias("review_records"))
    shape = member_rows.agg(F.countDistinct("golden_id").alias("golden_entity_count"), F.count("*").alias("member_count"))
    one = F.lit(1).alias("one")
    row = pairs.withColumn("one", one).join(records.withColumn("one", one), "one").join(shape.withColumn("one", one), "one")
    row = row.withColumn("unresolved_records", F.expr("total_source_records - confirmed_records - review_records")).withColumn("conflict_rate", percent(F.col("c"), F.col("total_pairs")))
    health = (F.col("confirmed_records") + F.col("review_records") * F.lit(float(limits["review_member_weight"]))) / F.when(F.col("total_source_records") != 0, F.col("total_source_records")) * 100.0 - F.coalesce("conflict_rate", F.lit(0.0)) * F.lit(float(limits["conflict_penalty_weight"]))
    return row.select(
        "total_pairs", percent(F.col("m"), F.col("total_pairs")).alias("match_rate"), percent(F.col("p"), F.col("total_pairs")).alias("possible_match_rate"), "conflict_rate", "total_source_records", "confirmed_records", "review_records", "unresolved_records",
        percent(F.col("unresolved_records"), F.col("total_source_records")).alias("unresolved_rate"), "golden_entity_count", (F.col("member_count") / F.when(F.col("golden_entity_count") != 0, F.col("golden_entity_count"))).alias("avg_cluster_size"),
        F.when(health.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), health))).alias("resolution_health"),
    )
