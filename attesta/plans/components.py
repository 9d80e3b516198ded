"""Connected components of an edge list, without bringing the graph to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.session import discard, materialise


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph -> (node, component)."""
    parent: dict = {}
    value: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ends = []
            for v in pair:
                k = tuple(v.values()) if isinstance(v, dict) else v
                parent.setdefault(k, k)
                value.setdefault(k, v)
                ends.append(find(k))
            parent[max(ends)] = min(ends)  # the smallest node leads
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(value.values()), kind), pa.array([value[find(k)] for k in value], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 100, in_one_task: int = 0) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    A graph of at most ``in_one_task`` distinct edges, which are counted first, is solved by one
    task; its nodes may be numbers, texts or flat structs of them.

    Each round sends the smallest label over every edge and then jumps (a label is replaced by its
    own label), so the number of rounds grows with the logarithm of the diameter. Labels are
    written to the shared folder each round. Self loops and repeated edges are fine; rows with a
    null end are ignored; an empty edge list gives an empty table. The type of a node is kept.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs = materialise(given.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-pairs")
    if in_one_task and pairs.limit(in_one_task + 1).count() <= in_one_task:
        kind = pairs.schema["u"].dataType.simpleString()
        labels = materialise(pairs.coalesce(1).mapInArrow(_solve, f"node {kind}, component {kind}"), "cc-labels")
        discard(pairs)
        return labels
    # each node keeps the edge to its smallest smaller neighbour and ties its others to that one: many edges fall together
    down = pairs.where("u <> v")
    low = down.groupBy("v").agg(F.min("u").alias("m"))
    tied = down.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
    alone = pairs.where("u = v").select("u", "v")
    both = materialise(tied.union(tied.select("v", "u")).union(alone).distinct(), "cc-edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "cc-labels")
    written = labels
    for _ in range(max_rounds):
        told = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("n1")).agg(F.min("label").alias("heard"))
        best = labels.join(told, labels["node"] == told["n1"]).select("node", "label", F.least("label", "heard").alias("better"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = best.join(jump, best["better"] == jump["via"], "left").select("node", F.least("better", "far").alias("label"), (F.least("better", "far") < F.col("label")).alias("changed"))
        new = materialise(new, "cc-labels")
        discard(written)
        written, labels = new, new.select("node", "label")
        if new.where("changed").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(pairs, both)
    return labels.select("node", F.col("label").alias("component"))
