"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

Leaves are (domain, language, source). The token budget is handed down the tree: each node deals its
allotment to its children in proportion to their weights, but none gets more than it can give
(tokens times the epochs allowed); what one cannot take goes to its siblings by their weights. A
node's capacity is that of its leaves, so a shortage reaches a node's ancestors, and their other
children, only after its siblings are full. All arithmetic is in whole tokens and exact.

A leaf then takes whole epochs and a token-prefix of one more, in an order of documents that a seed
and the epoch's number give. The prefix's last document is found by sums over hash buckets (many per
leaf, so a leaf with a third of all rows is not one task) and then inside one bucket per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.session import materialise, quoted

LEVELS = ["domain", "lang", "source"]
#: Leaf rows are sent to all executors up to this many; beyond it they are joined by a shuffle.
BROADCAST_LEAVES = 50_000
#: Rows aimed at in a hash bucket of a leaf.
BUCKET_ROWS = 2000
_WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def token_prefix(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word and the white space after it."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.regexp_like(text, F.lit(r"^[\x20\x09-\x0D]")), 1).otherwise(0)
    return F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), "")


def allot(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``allotted``: each node's part of its parent's ``given``; nodes have weight, capacity and given (all whole numbers).

    Children in the order of capacity / weight; child i is full if (given - capacities before it) *
    weight >= capacity * (weights from it on). The rest is dealt by weight; what rounding leaves goes
    one token each to the first by name. A weight of 0 takes part only in what full siblings leave
    over, which it does not: its allotment is 0.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = by.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name))
    live = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast("long"))).withColumn("weight", F.greatest("weight", F.lit(1).cast("long")))
    live = live.withColumn("_before", F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("capacity")).withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    full = live.withColumn("_full", (F.col("given") - F.col("_before")) * F.col("weight") >= F.col("capacity") * F.col("_rest"))
    spare = full.withColumn("_spare", F.col("given") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(by)).withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0)).over(by))
    part = spare.withColumn("allotted", F.when(F.col("_full"), F.col("capacity")).otherwise(F.expr("(_spare * weight) div _open")))
    left = part.withColumn("_left", F.col("given") - F.sum("allotted").over(by)).withColumn("_rank", F.sum(F.when(~F.col("_full"), 1).otherwise(0)).over(by.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)))
    return left.withColumn("allotted", F.col("allotted") + F.when(~F.col("_full") & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)).drop("_before", "_rest", "_full", "_spare", "_open", "_left", "_rank")


def quotas(leaves: DataFrame, weights: dict[tuple[str, ...], int], percent: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, available, rows, quota) from (…, available, rows); weights by path, 1 where none is given."""
    spark = leaves.sparkSession
    given = spark.createDataFrame([(list(k), int(w)) for k, w in weights.items()], "path array<string>, weight long")

    def weigh(df: DataFrame, depth: int) -> DataFrame:
        path = F.array(*LEVELS[:depth])
        return df.withColumn("_path", path).join(F.broadcast(given.withColumnRenamed("path", "_path")), "_path", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long"))).drop("_path")

    leaf = leaves.withColumn("capacity", F.col("available") * max_epochs)
    above, parents = None, []
    for depth, name in enumerate(LEVELS, 1):
        keys = LEVELS[:depth]
        nodes = weigh(leaf.groupBy(*keys).agg(F.sum("capacity").cast("long").alias("capacity"), F.sum("available").cast("long").alias("available")), depth)
        # the root's allotment: the budget, or all that there is
        nodes = nodes.join(above, parents) if above is not None else nodes.withColumn("given", F.expr(f"least(sum(available) over () * {percent} div 100, sum(capacity) over ())"))
        above = allot(nodes, parents, name).select(*keys, F.col("allotted").cast("long").alias("given"))
        parents = keys
    return leaves.join(above.withColumnRenamed("given", "quota"), LEVELS)


def _leaf_columns(docs: DataFrame, domain: Column) -> dict[str, Column]:
    none = F.lit("(none)")
    return {"domain": F.coalesce(domain.cast("string"), none), "lang": F.coalesce(F.col("lang").cast("string"), none), "source": F.coalesce(F.col("source").cast("string"), none)}


def _order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_digest")).cast("binary"))


def plan(docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], int], percent: int, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, leaves): narrow rows of all documents, and for each leaf its whole epochs, and where its prefix ends.

    A leaf's prefix takes all documents with an order key below ``cut_key`` and ``cut_tokens`` tokens
    of those at it.
    """
    narrow = docs.select("doc_id", *[c.alias(k) for k, c in _leaf_columns(docs, domain).items()], n_tokens(F.col("text")).alias("n_tokens"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_digest"))
    rows = materialise(narrow, "mix-rows").where("n_tokens > 0")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available"), F.count("*").alias("rows"))
    leaf = materialise(quotas(leaves, weights, percent, max_epochs).withColumns({"epochs": F.expr("quota div available"), "rest": F.expr("quota % available"), "buckets": F.ceil(F.col("rows") / BUCKET_ROWS)}), "mix-leaves")
    small = leaf.count() <= BROADCAST_LEAVES
    known = F.broadcast(leaf) if small else leaf
    keyed = rows.join(known.where("rest > 0"), LEVELS).withColumn("key", _order_key(seed, F.col("epochs")))
    keyed = keyed.withColumn("bucket", F.expr("(cast(conv(substring(key, 1, 8), 16, 10) as bigint) * buckets) div 4294967296"))
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    edge = sums.withColumn("before", upto - F.col("tokens")).where("before <= rest and rest < before + tokens").select(*LEVELS, "bucket", (F.col("rest") - F.col("before")).alias("inside"))
    near = keyed.join(F.broadcast(edge) if small else edge, [*LEVELS, "bucket"])
    by_key = near.groupBy(*LEVELS, "key", "inside").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    cut = by_key.withColumn("before", upto - F.col("tokens")).where("before <= inside and inside < before + tokens").select(*LEVELS, F.col("key").alias("cut_key"), (F.col("inside") - F.col("before")).alias("cut_tokens"))
    return rows, materialise(leaf.join(cut, LEVELS, "left"), "mix-cuts")


def _select(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Rows of one or more epochs with ``epoch`` and ``taken`` (> 0)."""
    at = rows.join(F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves, LEVELS).withColumn("key", _order_key(seed, F.col("epochs")))
    whole = at.withColumn("last", F.when(F.col("key") < F.col("cut_key"), F.col("epochs")).otherwise(F.col("epochs") - 1)).where("last >= 0")
    whole = whole.withColumn("epoch", F.explode(F.expr("sequence(0, last)"))).withColumn("taken", F.col("n_tokens"))
    # rows that repeat at the cut: copies one after another
    copy = F.row_number().over(Window.partitionBy(*LEVELS).orderBy("key")) - 1
    edge = at.where("key = cut_key and cut_tokens > 0").withColumn("epoch", F.col("epochs")).withColumn("taken", F.least(F.col("n_tokens"), F.col("cut_tokens") - copy * F.col("n_tokens"))).where("taken > 0")
    names = [*rows.columns, "epoch", "taken"]
    return whole.select(*names).unionByName(edge.select(*names))


def mix_rows(docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], int], percent: int = 50, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, taken for each selected (row, epoch).

    The budget is ``percent`` of all tokens (words), or all that ``max_epochs`` epochs hold if that
    is less; the sum of ``taken`` is the budget exactly, unless weights of 0 leave part of it
    unplaced. Null domains, languages and sources are the group "(none)". Texts without words have
    nothing to give and are in no epoch. Repeated rows count one by one; null ids are rows like
    others. An empty table gives an empty table. Other columns are not read.
    """
    rows, leaves = plan(docs, domain, weights, percent, max_epochs, seed)
    return _select(rows, leaves, seed).select("doc_id", *LEVELS, "epoch", "n_tokens", "taken")


def mix_documents(docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], int], percent: int = 90, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that one epoch of the mix takes, the documents at a leaf's cut shortened; columns as they came, whatever their names.

    Texts are not shuffled: a row is in or out by its own order key and its leaf's cut. Rows without
    words (null texts too) stay, as they cost nothing. Null domains, languages and sources are the
    group "(none)"; null ids are ids like others; equal rows count one by one. Texts of any length
    count whole. An empty table gives an empty table.
    """
    _, leaves = plan(docs, domain, weights, percent, 1, seed)
    cut = leaves.select(*LEVELS, "epochs", "cut_key", "cut_tokens")
    at = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), "doc_id", *[c.alias(f"{k}_of") for k, c in _leaf_columns(docs, domain).items()], n_tokens(F.col("text")).alias("n"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_digest"))
    at = at.select("doc", *[F.col(f"{k}_of").alias(k) for k in LEVELS], "n", _order_key(seed, F.lit(0)).alias("key"))
    at = at.join(F.broadcast(cut) if leaves.count() <= BROADCAST_LEAVES else cut, LEVELS, "left")
    whole = at.where("n = 0 or epochs >= 1 or key < cut_key")
    copy = F.row_number().over(Window.partitionBy(*LEVELS).orderBy("key")) - 1
    edge = at.where("n > 0 and epochs = 0 and key = cut_key and cut_tokens > 0").withColumn("taken", F.least(F.col("n"), F.col("cut_tokens") - copy * F.col("n"))).where("taken > 0")
    prefix = edge.withColumn("prefix", token_prefix(F.col("doc.text"), F.col("taken")))
    short = F.col("doc").withField("text", F.col("prefix")).withField("n_chars", F.length("prefix").cast(docs.schema["n_chars"].dataType))
    edge = prefix.select(F.when(F.col("taken") < F.col("n"), short).otherwise(F.col("doc")).alias("doc"))
    return whole.select("doc.*").unionByName(edge.select("doc.*"))
