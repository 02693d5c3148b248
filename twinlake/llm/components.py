"""Connected components of an edge table; nothing but counts reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_CHUNK = 500_000  # edges that a task contracts at once: 8 MB


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least node, node) of every node of these edges, by their components among themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            return nodes[label], nodes
        label = after


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label) of every node of the (a, b) edges: label is the least node that it reaches.

    Tasks first contract chunks of bounded size to stars; a table of one chunk is done then.  Otherwise every round moves each node's
    label to the least among its neighbours', then to that node's own label.  Rounds are written to the shared folder, so a lost
    executor repeats one round at most."""
    edges = common.checkpoint(edges.select("a", "b").where("a <> b"))
    chunks = -(-edges.count() // _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            label, node = contracted(*(np.concatenate([h[i] for h in held]) for i in range(2)))
            return pa.record_batch([pa.array(label), pa.array(node)], names=["a", "b"])

        for batch in common.gathered(batches, rows=20_000):
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(h[0]) for h in held) >= 2 * _CHUNK:
                yield out()
                held = []
        if held:
            yield out()

    stars = common.checkpoint(edges.repartition(max(1, chunks)).mapInArrow(run, "a long, b long"))
    if chunks <= 1:
        return stars.select(F.col("b").alias("node"), F.col("a").alias("label"))
    both = common.checkpoint(stars.union(stars.select("b", "a")).distinct().toDF("node", "other"))
    labels = common.checkpoint(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.toDF("other", "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.toDF("label", "beyond")
        after = common.checkpoint(moved.join(jump, "label", "left").select("node", F.least("label", "beyond").alias("label"), "was"))
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
