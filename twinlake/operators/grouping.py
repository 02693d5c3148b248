"""Groups from edges: components, then the greedy merge and the daisy-chain split in a fixed order within each component.

The greedy merge depends on order and needs the plain verdict between a group's representative and a newcomer, so it runs on one
component at a time; components come from label propagation on the edge table, and an edge table of verdicts serves as the lookup.
The edges of a component stream through the merge in (a, b) order whatever its size: a representative is the lesser end of every pair
that is looked up and stands no later than the edge at hand, so only the verdicts of representatives are held.  A greedy group of more
than ``split_budget`` members isn't split; it stays as merged and is flagged.
"""

from __future__ import annotations

import tempfile
from collections.abc import Container, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "group_id long, node long, rep long, difference double, flags int, joined long, blocked long, skipped boolean"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, a local session gets a folder of this machine; on a
    cluster that would lose data, so it raises."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if (current := sc._jsc.sc().getCheckpointDir()).isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="twinlake-")
    sc.setCheckpointDir(own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the folder that all executors share, and the lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


_CHUNK = 500_000  # edges that a task joins at once


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges -> (least node, node) of each of their components among themselves, by labels on both ends until none moves."""
    nodes, at = np.unique(np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()]), return_inverse=True)
    x, y = np.split(at, 2)
    label = np.arange(len(nodes))
    while True:
        low, after = np.minimum(label[x], label[y]), label.copy()
        for end in (x, y):
            np.minimum.at(after, label[end], low)
        after = after[after]
        if np.array_equal(after, label):
            return pd.DataFrame({"a": nodes[label], "b": nodes})
        label = after


def _chunks(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) >= 2 * _CHUNK:
            yield _joined(pd.concat(held))
            held = []
    if held:
        yield _joined(pd.concat(held))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the least node reachable over the (a, b) edges.

    Tasks join chunks of bounded size to stars first, which ends it for an edge table of one chunk; beyond that, labels spread over the
    stars and jump to their own label until none moves."""
    edges = checkpoint(edges.select("a", "b"))
    n = -(-edges.count() // _CHUNK)
    stars = checkpoint(edges.repartition(max(1, n)).mapInPandas(_chunks, "a long, b long"))
    if n <= 1:
        return stars.select(F.col("b").alias("node"), F.col("a").alias("component"))
    both = checkpoint(stars.union(stars.select("b", "a")).distinct().toDF("node", "other"))
    labels = checkpoint(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.toDF("other", "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        after = checkpoint(step.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("beyond", "component")).alias("component")))
        if not after.where("component <> was").limit(1).count():
            return after.select("node", "component")
        labels = after.select("node", "component")
    raise RuntimeError("components did not settle")


def merge_greedily(edges: Iterable[tuple[int, int, float, int]], plain: Container[tuple[int, int]], rep: dict[int, int] | None = None) -> tuple[dict[int, int], dict[int, int], dict[int, tuple], int]:
    """(node -> group, group -> representative, node -> (difference, flags, place), blocked) of edges in (a, b) order."""
    similar = lambda x, y: (min(x, y), max(x, y)) in plain
    group: dict[int, int] = {}
    rep = {} if rep is None else rep
    members: dict[int, list[int]] = {}
    how: dict[int, tuple] = {}
    blocked = 0
    for a, b, difference, flags in edges:
        ga, gb = group.get(a), group.get(b)
        if ga is None and gb is None:
            group[a] = group[b] = a
            rep[a], members[a] = a, [a, b]
            how[a], how[b] = (difference, 0, len(how)), (difference, flags, len(how) + 1)
        elif ga is not None and gb is not None:
            if ga == gb:
                continue
            if not similar(rep[ga], rep[gb]):
                blocked += 1
                continue
            for x in members.pop(gb):
                group[x] = ga
                members[ga].append(x)
        else:
            known, newcomer = (ga, b) if ga is not None else (gb, a)
            if not similar(rep[known], newcomer):
                blocked += 1
                continue
            group[newcomer] = known
            members[known].append(newcomer)
            how[newcomer] = (difference, flags, len(how))
    return group, rep, how, blocked


def prune(order: list[int], plain: set[tuple[int, int]]) -> list[int]:
    """Drops the member with the fewest similar others (the first on ties) while those are fewer than half of the present ones."""
    alive = list(order)
    near = {x: {y for y in alive if y != x and (min(x, y), max(x, y)) in plain} for x in alive}
    while len(alive) >= 2:
        worst = min(alive, key=lambda x: len(near[x]))  # min keeps the first
        if len(near[worst]) >= len(alive) // 2:
            break
        alive.remove(worst)
        for y in near[worst]:
            near[y].discard(worst)
    return alive


def split(order: list[int], plain: set[tuple[int, int]]) -> list[list[int]]:
    """A group of three or more -> groups whose members mostly resemble each other."""
    core = prune(order, plain)
    if len(core) == len(order):
        return [order]
    out = [core] if len(core) >= 2 else []
    rest = [x for x in order if x not in set(core)]
    left = set(rest)
    for start in rest:
        if start not in left:
            continue
        reach, queue = [start], [start]
        left.discard(start)
        while queue:
            x = queue.pop(0)
            for y in [y for y in rest if y in left and (min(x, y), max(x, y)) in plain]:
                left.discard(y)
                reach.append(y)
                queue.append(y)
        if len(reach) >= 2 and len(kept := prune([x for x in rest if x in set(reach)], plain)) >= 2:
            out.append(kept)
    return out


class _Seen:
    """Plain verdicts of the representatives so far and of the node at hand, filled while the edges stream by."""

    def __init__(self) -> None:
        self.near: dict[int, np.ndarray] = {}
        self.rep: dict[int, int] = {}

    def __contains__(self, pair: tuple[int, int]) -> bool:
        near = self.near[pair[0]]
        i = np.searchsorted(near, pair[1])
        return bool(i < len(near) and near[i] == pair[1])

    def emitted(self, rows: Iterable[tuple]) -> Iterator[tuple[int, int, float, int]]:
        for a, some in groupby(rows, itemgetter(1)):
            block = list(some)
            self.near[a] = np.array([r[2] for r in block if r[6]], np.int64)
            yield from (r[1:5] for r in block if r[5])
            if a not in self.rep:
                del self.near[a]


_MERGED = "merged long, size long, group_id long, node long, rep long, difference double, flags int, joined long, blocked long"


def _merge(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy groups of whole components, from rows in the order of (component, a, b)."""
    rows = (row for pdf in frames for row in zip(*(pdf[c].tolist() for c in ("component", "a", "b", "difference", "flags", "emitted", "plain")), strict=True))
    held: list[pd.DataFrame] = []
    for _, some in groupby(rows, itemgetter(0)):
        seen = _Seen()
        group, rep, how, blocked = merge_greedily(seen.emitted(some), seen, seen.rep)
        out = pd.DataFrame([(group[x], x, rep[group[x]], *how[x], blocked) for x in how], columns=["merged", "node", "rep", "difference", "flags", "joined", "blocked"])
        nodes = out.groupby("merged")["node"]
        held.append(out.assign(size=nodes.transform("size"), group_id=nodes.transform("min")))
        if sum(map(len, held)) >= 10_000 or len(held) >= 1_000:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def _parts(members: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """One greedy group, split by the plain verdicts among its members."""
    members = members.sort_values("joined").set_index("node", drop=False)
    plain = set(zip(pairs.a.tolist(), pairs.b.tolist(), strict=True))
    out = []
    for part in split(members.node.tolist(), plain):
        rows = members.loc[part]
        rep = int(rows.rep.iloc[0])
        out.append(rows.assign(group_id=min(part), rep=rep if rep in part else part[0]))
    return pd.concat([members.iloc[:0], *out]).assign(skipped=False)[["group_id", "node", "rep", "difference", "flags", "joined", "blocked", "skipped"]]


def greedy(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Members of greedy groups before any split, with the group's size."""
    used = edges.where("emitted OR plain").select("a", "b", F.col("difference").cast("double").alias("difference"), F.col("flags").cast("int").alias("flags"), "emitted", "plain")
    inside = used.join(label.toDF("a", "component"), "a").join(label.toDF("b", "component_b"), "b").where("component = component_b").drop("component_b")
    return inside.repartition("component").sortWithinPartitions("component", "a", "b").mapInPandas(_merge, _MERGED)


def groups(edges: DataFrame, daisy: bool = True, budget: int | None = None, split_budget: int = 131_000) -> DataFrame:
    """Members of groups.  edges: a < b, difference, flags, emitted (passed all gates), plain (the plain verdict, also for pairs that
    weren't emitted); split_budget: members of a greedy group beyond which it isn't split but flagged; budget: only where a caller
    gives one, components of more members aren't merged at all but stay as found and are flagged."""
    edges = checkpoint(edges)
    label = components(edges.where("emitted"))
    large = None
    if budget is not None:
        sized = label.join(label.groupBy("component").agg(F.count("*").alias("size")), "component")
        large = sized.where(F.col("size") > budget).select(F.col("component").alias("group_id"), "node", F.col("component").alias("rep"), F.lit(0.0).alias("difference"), F.lit(0).alias("flags"), F.lit(0).cast("long").alias("joined"), F.lit(0).cast("long").alias("blocked"), F.lit(True).alias("skipped"))
        label = sized.where(F.col("size") <= budget).select("node", "component")
    merged = greedy(edges, label)
    out = ["group_id", "node", "rep", "difference", "flags", "joined", "blocked"]
    if not daisy:
        done = merged.select(*out, F.lit(False).alias("skipped"))
        return done if large is None else done.unionByName(large)
    merged = checkpoint(merged)
    kept = merged.where((F.col("size") < 3) | (F.col("size") > split_budget)).select(*out, (F.col("size") > split_budget).alias("skipped"))
    several = merged.where(F.col("size").between(3, split_budget))
    of = several.select("node", "merged")
    pairs = edges.where("plain").select("a", "b").join(of.toDF("a", "merged"), "a").join(of.toDF("b", "merged_b"), "b").where("merged = merged_b").select("merged", "a", "b")
    parts = several.groupBy("merged").cogroup(pairs.groupBy("merged")).applyInPandas(_parts, MEMBERS)
    done = kept.unionByName(parts)
    return done if large is None else done.unionByName(large)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select("a").union(edges.select("b")).toDF("node").groupBy("node").agg(F.count("*").alias("degree"))
