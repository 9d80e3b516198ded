"""Embedding near-duplicates by NN-descent.

1. *Classes.* Bitwise equal vectors are one node; a class counts with its size.
2. *Seeds.* Tables of random hyperplanes deal nodes into buckets, more of them the more hyperplanes a
   table has, so that a pair at the threshold shares a bucket as often at any size; a bucket is sorted along one
   more random direction and cut into overlapping blocks, and the nearest in a block are the first
   neighbours. No bucket is one task, whatever its size.
3. *Descent.* Each round joins neighbours of neighbours: every node compares the nodes that list it
   or that it lists among each other and tells each the better ones; each keeps its best K.
4. *Threshold edges.* Whatever a block or a join measures at cosine >= threshold counts for the
   components, whether a list has room for it or not: a spanning forest of those pairs is kept beside
   the lists, which joins the same nodes with fewer edges than nodes.
5. *Saturated lists.* A list of K links may be too short for a node's links. While there are such
   lists, seeds and descent are repeated with lists of neighbours outside the node's own component,
   so that a list holds what is not known yet, however large the component.
6. *Links.* Within a component members near its pivot (within half the threshold angle) are linked with
   each other by the triangle inequality and only counted; all others are compared with every
   member, in pairs of blocks. So n_links is exact within components, without expanding copies: this
   stands in for lists as long as a node's links, which would grow with the square of a group.
7. *Audit.* For a bounded sample of nodes all links are found by brute force, in one pass. Recall is
   the mean over the sampled nodes with links of the share that lies within components, so that a
   node in a huge group counts as much as one of an isolated pair; nodes outside large components are
   also averaged alone, and the lesser figure holds. The sample grows until it has enough of those.
   Under ``least_recall`` another round of seeds and descent follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attesta.plans.components import connected_components
from attesta.session import materialise

BLOCK = 256  # rows of a seed block
OVERLAP = 24
SHARED = 0.9  # least chance that a pair at the threshold shares a bucket
AUDIT_LINKED = 40  # sampled nodes with links outside large components, if the table has as many
AUDIT_MOST = 6400  # sampled nodes
LARGE = 0.01  # of all nodes: a large component
PAIR_BLOCK = 1024  # members of a component compared in one task with as many others
JOIN_BLOCK = 2048  # members of a node's lists compared with each other at once
CLOSE = 1e-12  # cosines this near the threshold are added up anew, in one order for all blocks


def _matrix(column: pd.Series) -> np.ndarray:
    """Unit vectors (double) from their bytes."""
    raw = list(column)
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as bytes of doubles of length 1; null for null, empty, zero and non-finite ones."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
            top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(top) or top == 0 or not np.isfinite(x).all():
                out.append(None)
            else:
                x = np.ldexp(x, -int(np.frexp(top)[1]))  # by a power of two, which rounds nothing
                out.append((x / np.sqrt(np.dot(x, x))).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "unit"])


def _near(s: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which products ``s`` = x @ y.T are >= threshold; a product's last digits depend on the block, so close ones are added up anew."""
    near = s >= threshold
    for i, j in zip(*np.nonzero(np.abs(s - threshold) <= CLOSE)):
        near[i, j] = float(np.sum(x[i] * y[j])) >= threshold
    return near


def _signs(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):  # vectors of different lengths never meet
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), -1)
                rng = np.random.default_rng([seed, x.shape[1]])
                for t in range(tables):
                    planes = rng.normal(size=(x.shape[1], bits))
                    code = ((x @ planes) > 0) @ (1 << np.arange(bits))
                    along = x @ rng.normal(size=x.shape[1])
                    key = (code.astype(np.int64) * tables + t) * 100_003 + x.shape[1]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(3)), pa.array(key), pa.array(along)], names=["id", "unit", "component", "bucket", "along"])

    return run


def _forest(near: np.ndarray) -> tuple[list, list]:
    """Edges (row, column) that connect what the symmetric matrix ``near`` connects."""
    left, right = [], []
    degree = near.sum(1)
    todo = degree > 0
    while todo.any():
        first = int(np.argmax(np.where(todo, degree, 0)))
        todo[first] = False
        queue = [first]
        while queue and todo.any():
            row = queue.pop()
            new = np.flatnonzero(near[row] & todo)
            todo[new] = False
            left += [row] * len(new)
            right += new.tolist()
            queue += new.tolist()
    return left, right


def _best(x: np.ndarray, ids: np.ndarray, component: np.ndarray, k: int, threshold: float, worst: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(id, neighbour, cosine, tree): for each row its k nearest of other components, if better than ``worst``; and a forest of the links (tree)."""
    s = x @ x.T
    near = _near(s, x, x, threshold)
    same = component[:, None] == component[None, :]
    s[same], near[same] = -2, False
    k = min(k, len(x) - 1)
    first = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rows, cols = np.repeat(np.arange(len(x)), k), first.ravel()
    keep = s[rows, cols] > (-2 if worst is None else worst[rows])
    left, right = _forest(near)
    rows, cols = np.r_[rows[keep], np.array(left, np.int64)], np.r_[cols[keep], np.array(right, np.int64)]
    return ids[rows], ids[cols], s[rows, cols], np.arange(len(rows)) >= len(rows) - len(left)


def _edges(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["a", "b", "sim", "tree"])


def _blocks(k: int, threshold: float):
    """Rows (bucket, id, unit, component) by bucket and direction -> edges of overlapping blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, units, own, fresh = None, [], [], [], 0

        def edges() -> pa.RecordBatch:
            return _edges([_best(np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1), np.array(ids, np.int64), np.array(own, np.int64), k, threshold)])

        for batch in batches:
            for bucket, i, u, c in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if bucket != last or len(ids) >= BLOCK:
                    if fresh and len(ids) > 1:
                        yield edges()
                    ids, units, own = (ids[-OVERLAP:], units[-OVERLAP:], own[-OVERLAP:]) if bucket == last else ([], [], [])
                    last, fresh = bucket, 0
                ids.append(i)
                units.append(u)
                own.append(c)
                fresh += 1
        if fresh and len(ids) > 1:
            yield edges()

    return run


def _meet(k: int, threshold: float):
    """Rows (node, member, unit of the member, its component, cosine of its worst neighbour) by node -> better edges among the members of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list, list] = ([], [], [], [], [])

        def flush(cut: int):
            node = np.array(held[0][:cut])
            ids, own, worst = np.array(held[1][:cut], np.int64), np.array(held[3][:cut], np.int64), np.array(held[4][:cut])
            heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            out = []
            for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), cut]):
                for at in range(lo, hi, JOIN_BLOCK):  # a node listed by very many compares them block by block; audit and seeds stand in for the rest
                    end = min(hi, at + JOIN_BLOCK)
                    if end - at > 1:
                        out.append(_best(np.frombuffer(b"".join(held[2][at:end]), np.float64).reshape(end - at, -1), ids[at:end], own[at:end], k, threshold, worst[at:end]))
            for part in held:
                del part[:cut]
            return _edges(out) if out else None

        for batch in batches:
            for c in range(5):
                held[c].extend(batch.column(c).to_pylist())
            if len(held[0]) >= 4096:
                cut = len(held[0])
                last = held[0][-1]
                while cut and held[0][cut - 1] == last and len(held[0]) - cut < 4096:
                    cut -= 1
                cut = cut or len(held[0])
                if (found := flush(cut)) is not None:
                    yield found
        if held[0] and (found := flush(len(held[0]))) is not None:
            yield found

    return run


def _keep_best(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node (place 1 to k), and the edges of forests."""
    best = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("tree").alias("tree"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return best.withColumn("place", place).where((F.col("place") <= k) | F.col("tree"))


def _link_pairs(threshold: float):
    """A pair of blocks of one component -> links of each left member (multiplicities added)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "links": []}).astype({"id": "int64", "links": "int64"})
        x, y = _matrix(left["unit"]), _matrix(right["unit"])
        near = _near(x @ y.T, x, y, threshold)
        near &= left["id"].to_numpy()[:, None] != right["id"].to_numpy()[None, :]
        return pd.DataFrame({"id": left["id"].to_numpy(), "links": near @ right["copies"].to_numpy()})

    return run


def _brute(sample_ids: np.ndarray, sample: list[bytes], threshold: float):
    """Rows (id, unit, component) -> (sampled node, component, its links there), added up by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = {}
        for i, u in zip(sample_ids.tolist(), sample):
            by_size.setdefault(len(u), []).append((i, u))
        for batch in batches:
            raw, ids, components = batch.column(1).to_pylist(), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            sizes = np.array([len(r) for r in raw])
            for size, own in by_size.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    x, names = np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), -1).T, np.array([i for i, _ in own], np.int64)
                    for lo in range(0, len(own), PAIR_BLOCK):
                        asked = np.frombuffer(b"".join([u for _, u in own[lo : lo + PAIR_BLOCK]]), np.float64).reshape(-1, len(x))
                        near = _near(asked @ x, asked, x.T, threshold)
                        near &= names[lo : lo + PAIR_BLOCK, None] != ids[at][None, :]
                        r, c = np.nonzero(near)
                        pairs, links = np.unique(np.c_[names[lo + r], components[at][c]], axis=0, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(links.astype(np.int64))], names=["a", "component", "links"])

    return run


def audited(labelled: DataFrame, n: int, threshold: float, audit: int, salt: int) -> float | None:
    """Recall of the links of sampled nodes of ``labelled`` (id, unit, component); None if none has a link."""
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    while True:
        drawn = labelled.orderBy(F.xxhash64("id", F.lit(salt))).limit(audit)
        sample = drawn.join(sizes, "component").select("id", "unit", "component", "size").toPandas()  # AUDIT_MOST rows at most
        truth = labelled.select("id", "unit", "component").mapInArrow(_brute(sample["id"].to_numpy(np.int64), list(sample["unit"]), threshold), "a long, component long, links long")
        own = truth.join(F.broadcast(drawn.select(F.col("id").alias("a"), F.col("component").alias("mine"))), "a")
        met = own.groupBy("a").agg((F.sum(F.when(F.col("component") == F.col("mine"), F.col("links")).otherwise(0)) / F.sum("links")).alias("share")).toPandas()
        met = met.merge(sample[["id", "size"]], left_on="a", right_on="id")
        small = met["share"][met["size"] <= max(LARGE * n, 2)]
        if len(small) >= AUDIT_LINKED or audit >= min(n, AUDIT_MOST):
            return min((float(c.mean()) for c in (met["share"], small) if len(c)), default=None)
        audit = min(4 * audit, AUDIT_MOST)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, k: int = 8, tables: int = 10, rounds: int = 2, audit: int = 400, least_recall: float = 0.97, attempts: int = 3) -> DataFrame:
    """id, n_links, component_id, kept, recall for every row of ``vectors``.

    n_links counts other rows with cosine >= ``threshold`` (double precision) among those found;
    component_id is the smallest id reachable; kept is id = component_id. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are their own component;
    vectors of different lengths never link. Rows that repeat an id are rows of their own: with
    equal vectors they are linked copies, with different ones they may be in different components. Rows with a null id link with
    nothing and have a null component. ``recall`` is the audited share of links found, null
    if the audit met no link. ``tables`` is the least number of tables of seeds. An empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    units = materialise(given.mapInArrow(_unit, "id long, unit binary"), "nn-units")
    live = units.where("id is not null and unit is not null")
    classes = materialise(live.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nn-classes")
    # a repeated id that leads several classes: the classes' nodes must differ
    nodes = classes.select(F.col("id").alias("vec"), "unit", "copies", F.row_number().over(Window.partitionBy("id").orderBy("unit")).alias("turn"))
    twice = not nodes.where("turn > 1").isEmpty()
    nodes = materialise(nodes.select(F.expr("case when turn = 1 then vec else -1 - (xxhash64(unit) & 4611686018427387903) end" if twice else "vec").alias("id"), "vec", "unit", "copies"), "nn-nodes")
    n = nodes.count()
    bits = max(1, min(40, int(np.ceil(np.log2(max(n, 2) / 64)))))
    plain = nodes.select("id", "unit")
    alike = 1 - float(np.arccos(np.clip(threshold, -1, 1))) / np.pi  # chance of one side of a hyperplane
    if alike < 1:
        tables = max(tables, int(np.ceil(np.log(1 - SHARED) / np.log1p(-(alike**bits)))))
    form = "a long, b long, sim double, tree boolean"
    graph, recall, turn = None, None, 0
    component = plain.select("id", F.col("id").alias("component"))
    for attempt in range(attempts):
        saturated = True
        while saturated:
            labelled = materialise(plain.join(component, "id"), "nn-labelled")
            dealt = labelled.select("id", "unit", "component").mapInArrow(_signs(tables, bits, 1000 + turn), "id long, unit binary, component long, bucket long, along double")
            # a bucket is cut along its direction into ranges, so that no bucket is one task
            spread = dealt.repartitionByRange("bucket", "along").sortWithinPartitions("bucket", "along", "id").select("bucket", "id", "unit", "component")
            found = spread.mapInArrow(_blocks(k, threshold), form)
            if graph is not None:  # what earlier lists hold outside the components
                ends = graph.join(component.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(component.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
                found = found.unionByName(ends.where("ca <> cb").select("a", "b", "sim", "tree"))
            graph = materialise(_keep_best(found, k), "nn-graph")
            for _ in range(rounds):
                lists = graph.where(F.col("place") <= k)
                worst = lists.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
                lists = lists.select(F.col("a").alias("node"), F.col("b").alias("member")).union(lists.select("b", "a")).union(plain.select("id", "id")).distinct()
                known = labelled.join(worst, labelled["id"] == worst["a"], "left").select(F.col("id").alias("member"), "unit", "component", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
                met = lists.join(known, "member").select("node", "member", "unit", "component", "worst").repartition("node").sortWithinPartitions("node", "member")
                better = met.mapInArrow(_meet(k, threshold), form)
                graph = materialise(_keep_best(better.unionByName(graph.select("a", "b", "sim", "tree")), k), "nn-graph")
            linked = graph.where("tree")
            saturated = not graph.where((F.col("sim") >= threshold) & (F.col("place") == k)).isEmpty()
            joined = connected_components(linked.select("a", "b").union(component.where("id <> component").select("id", "component")))
            component = materialise(plain.select("id").join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "nn-components")
            turn += 1
        recall = audited(plain.join(component, "id"), n, threshold, audit, attempt) if n else None
        if recall is None or recall >= least_recall:
            break

    # lists enlarged to components
    sizes = component.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    members = component.join(sizes, "component").join(nodes, "id")
    pivots = nodes.select(F.col("id").alias("component"), F.col("unit").alias("pivot"))
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-7 if threshold < 1 else 2.0  # within this of the pivot: linked with each other

    def to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [float(np.dot(np.frombuffer(u, np.float64), np.frombuffer(p, np.float64))) for u, p in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(np.array(s) >= half)], names=["component", "id", "unit", "copies", "size", "core"])

    form = "component long, id long, unit binary, copies long, size long, core boolean"
    placed = materialise(members.join(pivots, "component").select("component", "id", "unit", "copies", "size", "pivot").mapInArrow(to_pivot, form), "nn-members")
    cores = placed.where("core").groupBy("component").agg(F.sum("copies").alias("core_copies"))
    inside = placed.where("core").join(cores, "component").select("id", (F.col("core_copies") - F.col("copies")).alias("links"))
    # pairs with at least one end outside the core, both ways: outer members (left) against all (right), core members (left) against
    # outer ones; core and outer members are dealt into blocks by their own numbers, and a row goes to as many tasks as there are
    # blocks of the other kind, so one outer member costs a pass over the core
    parts = placed.groupBy("component").agg(*[F.ceil(F.count(F.when(F.col("core") == F.lit(kind), 1)) / PAIR_BLOCK).alias(name) for name, kind in (("core_blocks", True), ("outer_blocks", False))]).where("outer_blocks > 0")
    open_ = placed.join(parts, "component").withColumn("own", F.expr("pmod(xxhash64(id), case when core then core_blocks else outer_blocks end)"))
    kinds = [("core", "outer"), ("outer", "core"), ("outer", "outer")]
    sides = []
    for number, (left, right) in enumerate(kinds):
        for side, kind, facing in ((0, left, right), (1, right, left)):
            rows = open_.where("core" if kind == "core" else "not core").where(f"{facing}_blocks > 0").withColumn("other", F.explode(F.expr(f"sequence(0, {facing}_blocks - 1)")))
            i, j = ("own", "other") if side == 0 else ("other", "own")
            sides.append(rows.select("component", F.lit(number).alias("kind"), F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "id", "unit", "copies"))
    pairs = sides[0]
    for more in sides[1:]:
        pairs = pairs.unionByName(more)
    outside = pairs.groupBy("component", "kind", "i", "j").applyInPandas(_link_pairs(threshold), "id long, links long")
    links = inside.unionByName(outside).groupBy("id").agg(F.sum("links").alias("links"))

    # back to rows
    named = nodes.join(component, "id").join(links, "id", "left").select("unit", "component", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    real = component.join(nodes, "id").groupBy("component").agg(F.min("vec").alias("component_id"))
    named = named.join(real, "component").select("unit", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    linked = live.join(named, "unit").select("id", "n_links", "component_id")
    alone = units.where("id is null or unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = linked.unionByName(alone)
    return rows.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"), F.lit(recall).cast("double").alias("recall"))
