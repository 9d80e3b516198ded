"""Exact Jaccard join on word n-gram sets by T-occurrence search (DivideSkip).

Two sets x and y with Jaccard >= t share at least T = ceil(t / (1 + t) * (|x| + |y|)) members, so a
partner of x is a document that occurs in at least T of the inverted lists of x's members. Lists
are built and searched block by block; what decides which documents meet in a block is exact:

1. Every document becomes a set of 64-bit shingle hashes; equal sets form one class, and only the
   smallest document of a class goes on.
2. *Routing.* Sizes are cut into bands. Within a band two similar sets differ in at most H members,
   so if the hash space is dealt into H + T segments, T of them at least are equal in both
   (pigeonhole). A document's segment signatures are again a set to which T-occurrence applies:
   signatures that no other document has are dropped; a document with fewer than T left is done; of
   the others all but the T - 1 most frequent are kept (two documents that share T signatures share
   one of these). So passages that many documents share do not make documents meet. Documents that
   share a kept signature form a candidate cluster.
3. *Search.* The documents of a cluster are one block: their sets are indexed and each is looked up
   by DivideSkip. The shorter lists are merged, candidates are then probed in the longer ones by
   binary search, and those that cannot reach T are let go. Documents already in one component are
   not compared again.
4. *Large clusters.* A cluster of more than ``block`` documents or ``BLOCK_MEMBERS`` members is first
   verified against the hubs of its signatures, which joins groups of near copies in linear work,
   however large they are. If several components are left, what lies outside the largest one is
   dealt into blocks and looked up in blocks of the whole cluster as above.

Sets are compared by 64-bit hashes of their shingles. Hashes of different shingles of two documents
with u distinct shingles together are equal with a chance of about u * u / 2**65 (u = 20,000: one in
10**11), which alone could shift an overlap by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attesta.llm._arrow import mix, text_slices, word_hashes, words
from attesta.plans.components import connected_components
from attesta.session import discard, materialise, quoted, spare_name

_K = [np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text.

    With fewer than n words the whole sequence is one shingle; without words the set is empty.
    """
    salts = [mix(np.arange(1, n + 1, dtype=np.uint64) * _K[0] + np.uint64(k)) | np.uint64(1) for k in range(1, n + 1)]
    for _, _, data, offsets in text_slices(column):
        starts, stops, first = words(data, offsets)
        h = word_hashes(data, starts, stops)
        count = max(0, len(h) - n + 1)
        full = np.zeros(count, np.uint64)
        for i in range(n):
            full += h[i : i + count] * salts[n - 1][i]
        full = mix(full)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(full[a : b - n + 1])
            elif b > a:
                yield mix(np.sum(h[a:b] * salts[b - a - 1][: b - a], keepdims=True) + _K[4] * np.array([b - a], np.uint64))
            else:
                yield h[:0]


def required(a, b, t: Fraction):
    """Least overlap of sets of sizes a and b (numbers or arrays) with Jaccard >= t: ceil(t (a + b) / (1 + t))."""
    return -(-t.numerator * (a + b) // (t.numerator + t.denominator))


class Bands:
    """Size bands of ratio 1 / t**3 and the number of segments in each.

    A set routes by its own band, and by the next one too if a similar set may lie there.
    """

    def __init__(self, t: Fraction, largest: int = 1 << 40):
        self.t, self.edges = t, [1]
        while self.edges[-1] <= largest:
            self.edges.append(max(ceil(self.edges[-1] / t), int(self.edges[-1] / float(t) ** 3)) + 1)
        self.edges_np = np.array(self.edges, np.int64)
        # what meets in band i are sizes below edges[i + 1]
        self.differ = [int((1 - t) * 2 * (hi - 1) / (1 + t)) for hi in self.edges[1:]]
        self.shared = [1 + d // 6 for d in self.differ]
        self.segments = [d + s for d, s in zip(self.differ, self.shared)]

    def differences(self, size: int, band: int) -> int:
        """Most members by which a set of ``size`` differs from a similar one that it meets in the band."""
        partner = min(size * self.t.denominator // self.t.numerator, self.edges[band + 1] - 1)
        return int((1 - self.t) * (size + partner) / (1 + self.t))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges_np, size, "right")) - 1


def signatures(members: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray]]:
    """(least number shared with a similar set, segment signatures) of one set, for its own band and, near its upper edge, the next one.

    T follows from the set's own size, so that the small sets of a band, whose segments hold few
    members, must share many. Empty segments may be equal too. With e of them a set shares T - e
    full ones at least; a set with T or more empty segments gives signatures to these as well. If a
    set must share more than the band's least number L, those among its signatures that come last
    by value are left out, as many as it must share beyond L: the first L that two similar sets
    share are then in both.
    """
    out = []
    band = bands.of(len(members))
    mixed = mix(members + _K[1])
    for i in (band, band + 1) if len(members) / bands.t >= bands.edges[band + 1] else (band,):
        k = bands.segments[i]
        t = k - bands.differences(len(members), i)
        salt = np.array([i], np.uint64) * _K[3]
        segment = ((members >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        # members are sorted, so segments are runs
        heads = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sigs = mix(np.add.reduceat(mixed, heads) + mix(segment[heads] * _K[2] + salt))
        if (empty := k - len(heads)) >= t:
            none = np.setdiff1d(np.arange(k, dtype=np.uint64), segment[heads])
            sigs = np.r_[sigs, mix(mix(none * _K[2] + salt) + _K[4])]
        least = max(1, t - empty)
        keep = min(least, bands.shared[i])
        if keep < least:  # any subset in a common order will do: the last ones by value need not be sent
            sigs = np.sort(sigs)[: len(sigs) - (least - keep)]
        out.append((keep, sigs))
    return out


def _digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows = [(len(s), int(mix(s).sum(dtype=np.uint64)) - 2**63, int(mix(s ^ _K[0]).sum(dtype=np.uint64)) - 2**63) for s in shingle_sets(part.column(1), n)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows)]], names=["node", "size", "d1", "d2"])

    return run


def _routes(n: int, t: Fraction):
    """(node, routes) of every set that is not empty."""
    bands = Bands(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sigs = [signatures(s, bands) if len(s) else [] for s in shingle_sets(part.column(1), n)]
                flat = [r for routes in sigs for r in routes]
                inner = pa.ListArray.from_arrays(np.cumsum([0, *[len(x) for _, x in flat]]).astype(np.int32), np.concatenate([np.zeros(0, np.uint64), *[x for _, x in flat]]).view(np.int64))
                routes = pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.int32()), inner], names=["least", "sigs"])
                offsets = pa.array(np.cumsum([0, *map(len, sigs)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, routes)], names=["node", "routes"])

    return run


def _sets(n: int):
    """Rows (node, text, ...) -> (node, set, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column(1), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets, part.column(2), part.column(3)], names=["node", "members", "cluster", "n"])

    return run


def _verify(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(overlap(x, y) >= required(len(x), len(y), t))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))


class InvertedIndex:
    """Inverted lists of a block of sets: for each member the sorted positions of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        members = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(members, kind="stable")  # owners stay ascending within a member
        members, self.owner = members[order], owner[order]
        self.keys, first = np.unique(members, return_index=True)
        self.first = np.r_[first, len(members)]

    def search(self, query: np.ndarray, t: Fraction, skip: np.ndarray | None = None) -> np.ndarray:
        """Positions of all sets with Jaccard >= t to ``query``, those in the mask ``skip`` left out.

        T-occurrence by DivideSkip: the long lists are set aside (at most T - 1 of them), the short
        ones are merged by counting, and what can still reach T is probed in the long lists.
        """
        q = len(query)
        fits = (self.sizes * t.denominator >= q * t.numerator) & (self.sizes * t.numerator <= q * t.denominator) & (self.sizes > 0)
        if skip is not None:
            fits &= ~skip
        if not q or not fits.any():
            return np.zeros(0, np.int64)
        least = required(q, int(self.sizes[fits].min()), t)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        if len(at) < least:
            return np.zeros(0, np.int64)
        lengths = self.first[at + 1] - self.first[at]
        at = at[np.argsort(lengths, kind="stable")]
        longest = int(lengths.max())
        aside = min(least - 1, int(least / (0.0085 * log2(longest + 1) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        merged = np.concatenate([self.owner[self.first[i] : self.first[i + 1]] for i in short])
        counts = np.bincount(merged, minlength=len(self.sizes))
        needed = required(q, self.sizes, t)
        alive = np.flatnonzero(fits & (counts > 0) & (counts + aside >= needed))
        for done, i in enumerate(long):
            if not len(alive):
                break
            lst = self.owner[self.first[i] : self.first[i + 1]]
            where = np.minimum(np.searchsorted(lst, alive), len(lst) - 1)
            counts[alive[lst[where] == alive]] += 1
            alive = alive[counts[alive] + (aside - done - 1) >= needed[alive]]
        return alive[counts[alive] >= needed[alive]]


def search_links(left: list[np.ndarray], right: list[np.ndarray], left_parts: np.ndarray, right_parts: np.ndarray, t: Fraction) -> list[tuple[int, int]]:
    """Links (left, right) that join components, at most one less than the sets; parts are component numbers, equal ones are not compared."""
    index, parts = InvertedIndex(left), left_parts.copy()
    names, out = right_parts.copy(), []
    for k, members in enumerate(right):
        while len(found := index.search(members, t, parts == names[k])):
            out.append((int(found[0]), k))
            old = parts[found[0]]  # the two components are one from here on
            parts[parts == old] = names[k]
            names[names == old] = names[k]
    return out


def _search_pairs(t: Fraction):
    """A block of a large cluster (side 0) in which a block of lookups (side 1) is searched."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        sets = [[np.frombuffer(x, np.uint64) for x in side["members"]] for side in (left, right)]
        links = search_links(*sets, left["component"].to_numpy(), right["component"].to_numpy(), t)
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        return pd.DataFrame([(int(a[i]), int(b[k])) for i, k in links], columns=["a", "b"], dtype="int64")

    return run


def _search_clusters(t: Fraction):
    """Rows (cluster, node, members) in order of cluster -> links; a cluster is held at a time."""

    def links(nodes: list, sets: list) -> pa.RecordBatch | None:
        parts = np.arange(len(nodes))
        found = search_links(sets, sets, parts, parts, t)
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[k] for _, k in found], pa.int64())], names=["a", "b"]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sets = None, [], []
        for batch in batches:
            for cluster, node, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if cluster != last:
                    if len(nodes) > 1 and (out := links(nodes, sets)) is not None:
                        yield out
                    last, nodes, sets = cluster, [], []
                nodes.append(node)
                sets.append(np.frombuffer(members.as_py(), np.uint64))
        if len(nodes) > 1 and (out := links(nodes, sets)) is not None:
            yield out

    return run


#: Members (8 bytes each) of the sets that are searched in one block.
BLOCK_MEMBERS = 2_000_000
#: Ids are sent to all executors up to this many (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows while the steps run: a row may hold a text and two sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: str = "0.9", block: int = 512) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, set_digest (two longs), component_id.

    component_id is the smallest id reachable over links, a link being Jaccard >= ``threshold`` (a
    decimal text, compared exactly). Null or wordless texts have the empty set (n_shingles 0), link
    with nothing and are their own component. Rows with the same id are one node: each row is
    returned, with the common component. Rows with a null id are returned with a null component and
    link with nothing. Other columns are not read. An empty table gives an empty table.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, id_col, text_col, n, Fraction(threshold), block)


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, t: Fraction, block: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    digests = materialise(texts.mapInArrow(_digests(n), "node long, size long, d1 long, d2 long"), "jaccard-digests")
    full = digests.where("size > 0 and node is not null")

    # 1. classes of equal sets
    classes = materialise(full.groupBy("d1", "d2", "size").agg(F.min("node").alias("rep")), "jaccard-classes")
    copies = materialise(full.join(classes, ["d1", "d2", "size"]).select(F.col("rep").alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), "jaccard-copies")

    # 2. routing: documents that share enough segment signatures
    # signatures are made from the texts once more, which costs less than keeping them; copies of a class are left out
    alone = copies.select(F.col("b").alias("node")).distinct().join(classes.select(F.col("rep").alias("node")), "node", "left_anti")
    routes = texts.where("node is not null").mapInArrow(_routes(n, t), "node long, routes array<struct<least: int, sigs: array<bigint>>>").join(_bounded(alone), "node", "left_anti")
    routes = routes.select("node", F.posexplode("routes").alias("slot", "r")).select("node", "slot", "r.least", F.explode("r.sigs").alias("sig"))
    common = routes.withColumn("df", F.count("*").over(Window.partitionBy("sig"))).where("df > 1")
    own = Window.partitionBy("node", "slot")
    kept = common.withColumn("n", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("df", "sig"))).where("place <= n - least + 1")
    kept = materialise(kept.select("sig", "node"), "jaccard-kept")
    # the smallest node of a group of near copies leads most of the group's signatures, so hubs are few
    hubs = kept.groupBy("sig").agg(F.min("node").alias("a"))
    stars = materialise(kept.join(hubs, "sig").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "jaccard-candidates")

    cluster = connected_components(stars).withColumnRenamed("component", "cluster")
    cluster = materialise(cluster.join(full.select("node", "size").groupBy("node").agg(F.max("size").alias("size")), "node"), "jaccard-members")
    sizes = cluster.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("total")).select("cluster", (F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / BLOCK_MEMBERS))).alias("blocks"))
    nodes = materialise(cluster.join(sizes, "cluster").select("node", "cluster", "blocks"), "jaccard-clusters")
    near = texts.join(_bounded(nodes), "node").select("node", "text", "cluster", "blocks").mapInArrow(_sets(n), "node long, members binary, cluster long, blocks long")
    if not full.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # ids that repeat
        near = near.distinct()
    near = materialise(near, "jaccard-sets")

    # 3. search
    small = near.where("blocks = 1").select("cluster", "node", "members").repartition("cluster").sortWithinPartitions("cluster", "node")
    linked = small.mapInArrow(_search_clusters(t), "a long, b long")

    # 4. large clusters: hubs first, then what they do not join
    large = near.where("blocks > 1")
    if not large.isEmpty():
        x, y = large.select(F.col("node").alias("a"), F.col("members").alias("x")), large.select(F.col("node").alias("b"), F.col("members").alias("y"))
        sized = F.expr(f"octet_length(x) * {t.numerator} <= octet_length(y) * {t.denominator} and octet_length(y) * {t.numerator} <= octet_length(x) * {t.denominator}")
        # each document against its smallest hub
        first = stars.groupBy("b").agg(F.min("a").alias("a"))
        joined = materialise(first.join(x, "a").join(y, "b").where(sized).select("a", "b", "x", "y").mapInArrow(_verify(t), "a long, b long"), "jaccard-hubs")
        members = large.select("node", "cluster").distinct().join(connected_components(joined), "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("component"))
        parts = materialise(members.groupBy("cluster", "component").agg(F.count("*").alias("n")), "jaccard-parts")
        lead = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("lead"), F.count("*").alias("parts")).where("parts > 1").select("cluster", "lead")
        dealt = materialise(members.join(lead, "cluster").withColumn("outside", F.col("component") != F.col("lead")), "jaccard-open").join(large.select("node", "members", "blocks"), "node")
        # blocks of what lies outside (they are as many as its documents and members ask for) meet all blocks of the cluster
        rows = dealt.groupBy("cluster").agg(F.count(F.when(F.col("outside"), 1)).alias("n"), F.sum(F.when(F.col("outside"), F.octet_length("members") / 8)).alias("total"))
        queries = rows.select("cluster", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / BLOCK_MEMBERS)).alias("lookups"))
        dealt = dealt.join(queries, "cluster").withColumn("i", F.expr("cast(pmod(xxhash64(node), lookups) as int)")).withColumn("j", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        asked = dealt.where("outside").select("cluster", "i", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")).alias("j"), F.lit(1).alias("side"), "node", "component", "members")
        index = dealt.select("cluster", F.explode(F.expr("sequence(0, cast(lookups as int) - 1)")).alias("i"), "j", F.lit(0).alias("side"), "node", "component", "members")
        linked = linked.union(joined).union(index.unionByName(asked).groupBy("cluster", "i", "j").applyInPandas(_search_pairs(t), "a long, b long"))

    component = connected_components(copies.union(linked))
    discard(classes, copies, kept, stars, cluster, nodes, near)
    return digests.join(component, "node", "left").select(
        F.col("node").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"), F.col("d1").alias("set_digest_1"), F.col("d2").alias("set_digest_2")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` less all but one of each component; columns as they came, whatever their names.

    Every row is a document. The row with the smallest id stays; of rows with the same id the one
    with the smallest digest of its text, and a null id comes after all others. Rows without words
    link with nothing, so all of them stay, repeated ones too; texts of any length are read whole.
    Ties at the threshold are links. An empty table gives an empty table.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        dropped = materialise(jaccard_classes(docs, **options).where("component_id <> doc_id").select("doc_id"), "jaccard-dropped")
        return docs.join(_bounded(dropped), "doc_id", "left_anti").select(*map(quoted, docs.columns))
    # ids are missing or repeat: rows are numbered, the numbers fixed by writing them
    row = spare_name(docs.columns, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-numbered")
    classes = jaccard_classes(numbered, id_col=row, **options).select(row, "component_id")
    order = numbered.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), row).alias("order"))
    first = classes.join(order, row).groupBy("component_id").agg(F.min("order").alias("first"))
    kept = materialise(first.select(F.col("first").getField(row).alias(row)), "jaccard-kept-rows")
    return numbered.join(kept, row, "left_semi").select(*map(quoted, docs.columns))
