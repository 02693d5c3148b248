"""Mixing of sources to target weights.

Leaves are (domain, language, source).  A leaf can give its tokens ``epochs`` times, an inner node what its children can.  The budget
goes down the tree: each node shares its own among its children by weight, as far as each can give; what one can't, its siblings get
by weight.  A node's whole shortage shows in what it can give, so it reaches the siblings of its ancestors only after its own
children are exhausted.  What lies under a weight of 0 counts nowhere, so the whole budget is placed while any leaf under positive
weights has room, but for rounding: shares are whole tokens, rounded down.

A leaf that gets more than its tokens is read whole for as many epochs as fit; the rest is a prefix of one further epoch, whose order
is the MD5 of seed, epoch and doc_id.  A document belongs to it if the tokens of those before it are fewer than the rest, so a leaf
overshoots by less than a document.  The prefix is found as one cut of the hash for each leaf, by sums over buckets of the hash, so no
leaf is sorted: only its bucket with the cut is.  Applied to documents, a decision needs its leaf's row and nothing else.

Cases: null domain, language or source is the name ""; null text has no tokens; documents without tokens go along with their leaf's
whole epochs and cut; rows of equal doc_id in a leaf go together; unknown names have weight 1 and weight 0 gives nothing; a leaf
without tokens gets nothing; an empty table gives no rows; other columns pass through ``select`` untouched; names starting with
``_mix`` are reserved and raise a ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_BUCKET = 3  # hex digits
_BROADCAST_LEAVES = 500_000
_TREE = ["_mix_domain", "_mix_lang", "_mix_source"]


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{common.SPACE}]+")).cast("long")


def named(docs: DataFrame, domain: Column) -> DataFrame:
    """Adds the names of each document's leaf."""
    if taken := [c for c in docs.columns if c.lower().startswith("_mix")]:
        raise ValueError(f"column names starting with _mix are reserved: {taken}")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.withColumns(dict(zip(_TREE, (name(domain), name(F.col("lang")), name(F.col("source"))), strict=True)))


def _hash(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for k, w in weights.items():
        out = F.when(F.col(name) == k, F.lit(w).cast("long")).otherwise(out)
    return out


def _share(nodes: DataFrame, parents: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Splits each parent's budget among its children (cap: what a child can give, 0 if its weight is 0) and adds got."""
    order = Window.partitionBy(*parents, "budget").orderBy("ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents, "budget")
    df = nodes.withColumn("weight", _weight(name, weights))
    df = df.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(0.0)))
    zero = F.lit(0).cast("long")
    df = df.withColumns({"caps": F.coalesce(F.sum("cap").over(before), zero), "rest": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)})
    df = df.withColumn("full", F.col("cap") * F.col("rest") <= F.col("weight") * (F.col("budget") - F.col("caps")))
    df = df.withColumns({"given": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), zero), "open": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), zero)})
    got = F.when(F.col("full") | (F.col("open") == 0), F.col("cap")).otherwise(F.expr("weight * (budget - given) div open"))
    return df.withColumn("got", got).drop("weight", "ratio", "caps", "rest", "full", "given", "open")


def leaves(counted: DataFrame, weights: dict[str, dict[str, int]], budget_percent: int, epochs: int, seed: int) -> DataFrame:
    """One row for each leaf: tokens, got, whole epochs, rest, and the cut: documents up to this hash are in the prefix."""
    caps = common.checkpoint(counted.groupBy(*_TREE).agg(F.sum("n_tokens").alias("tokens")))
    available = caps.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    by = [weights.get(level, {}) for level in ("domain", "lang", "source")]
    # what each node can give, from the leaves up: children of weight 0 give nothing
    giving = lambda nodes, name, of: nodes.withColumn("cap", F.when(_weight(name, of) > 0, F.col("cap")).otherwise(F.lit(0).cast("long")))
    can = [giving(caps.select(*_TREE, (F.col("tokens") * epochs).alias("cap")), _TREE[2], by[2])]
    for depth in (1, 0):
        can.insert(0, giving(can[0].groupBy(*_TREE[: depth + 1]).agg(F.sum("cap").alias("cap")), _TREE[depth], by[depth]))
    at = can[0].withColumn("budget", F.lit(min(available * budget_percent // 100, available * epochs)).cast("long"))
    at = _share(at, [], _TREE[0], by[0]).select(_TREE[0], F.col("got").alias("budget"))
    at = _share(can[1].join(at, _TREE[:1]), _TREE[:1], _TREE[1], by[1]).select(*_TREE[:2], F.col("got").alias("budget"))
    at = _share(can[2].join(at, _TREE[:2]), _TREE[:2], _TREE[2], by[2]).select(*_TREE, "got")
    split = common.checkpoint(caps.join(at, _TREE).where("tokens > 0").select(*_TREE, "tokens", "got", F.expr("got div tokens").alias("whole"), F.expr("got % tokens").alias("rest")))
    hashed = _with_leaf(counted, split).where("rest > 0").withColumn("_mix_hash", _hash(F.col("whole"), seed)).withColumn("_mix_bucket", F.left("_mix_hash", F.lit(_BUCKET)))
    sums = hashed.groupBy(*_TREE, "_mix_bucket").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*_TREE).orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    edge = sums.withColumn("before", before).where("before < rest AND rest <= before + n").select(*_TREE, F.col("_mix_bucket").alias("_mix_edge"), "before")
    inside = _with_leaf(hashed.select(*_TREE, "_mix_hash", "_mix_bucket", "n_tokens", "rest"), edge).where("_mix_bucket = _mix_edge")
    inside = inside.groupBy(*_TREE, "_mix_hash").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    start = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy(*_TREE).orderBy("_mix_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    cut = inside.withColumn("start", start).where("start < rest").groupBy(*_TREE).agg(F.max("_mix_hash").alias("cut"))
    return common.checkpoint(split.join(cut, _TREE, "left"))


def _with_leaf(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Joins a table of leaves; broadcast if it is small enough, else by a shuffle whose large partitions Spark splits."""
    small = common.checkpoint(table)
    return docs.join(F.broadcast(small) if small.count() <= _BROADCAST_LEAVES else small, _TREE)


def _counted(docs: DataFrame, domain: Column) -> DataFrame:
    return common.checkpoint(named(docs, domain).select("doc_id", *_TREE, n_tokens(F.col("text").cast("string")).alias("n_tokens")))


def _copies(seed: int) -> tuple[Column, Column]:
    in_prefix = F.coalesce(_hash(F.col("whole"), seed) <= F.col("cut"), F.lit(False))
    return in_prefix, F.col("whole") + in_prefix.cast("long")


def report(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget_percent: int = 75, epochs: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, its leaf, tokens, whether it is in its leaf's prefix, and how often it is taken; a row for each document."""
    counted = _counted(docs, domain)
    table = leaves(counted, weights, budget_percent, epochs, seed)
    in_prefix, copies = _copies(seed)
    joined = counted.join(F.broadcast(table) if table.count() <= _BROADCAST_LEAVES else table, _TREE, "left")
    return joined.select("doc_id", F.col(_TREE[0]).alias("domain"), F.col(_TREE[1]).alias("lang"), F.col(_TREE[2]).alias("source"), "n_tokens", in_prefix.alias("in_prefix"), F.coalesce(copies, F.lit(0).cast("long")).alias("copies"))


def select(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget_percent: int = 75, epochs: int = 2, seed: int = 17) -> DataFrame:
    """The documents as often as they are taken, with their own columns; whole texts, which don't move."""
    table = leaves(_counted(docs, domain), weights, budget_percent, epochs, seed).select(*_TREE, F.col("whole"), F.col("cut"))
    table = table.withColumnsRenamed({"whole": "_mix_whole", "cut": "_mix_cut"})
    hash_ = _hash(F.col("_mix_whole"), seed)
    copies = (F.col("_mix_whole") + F.coalesce(hash_ <= F.col("_mix_cut"), F.lit(False)).cast("long")).cast("int")
    return _with_leaf(named(docs, domain), table).withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
