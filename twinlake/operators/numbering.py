"""Consecutive numbers in a global order without one task that reads all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import checkpoint


def ranged(df: DataFrame, order: list[Column], part: str = "_part", place: str = "_place") -> DataFrame:
    """Adds the range partition of each row in the order and its place in it, from 0.

    The rows are written to the shared folder, so that whatever is derived from them sees one partitioning: ranges are sampled anew and
    joined anew by size in each plan that has them, and sums by partition of one plan don't fit the rows of another."""
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()})
    return checkpoint(local.withColumn(place, F.col(place) - F.col(part).cast("long") * F.lit(1 << 33)))


def before(parts: DataFrame, total: Column, name: str, part: str = "_part") -> DataFrame:
    """(part, name): the sum of ``total`` over the parts before, a row a partition."""
    each = parts.groupBy(part).agg(total.alias("_total"))
    so_far = F.sum("_total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return each.select(part, F.coalesce(so_far, F.lit(0).cast("long")).alias(name))


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """Adds each row's place in the order: range partitions are sorted, and the sizes of those before are added up (a row a partition)."""
    local = ranged(df, order)
    sizes = before(local, F.count("*"), "_before")
    return local.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_place") + first).drop("_part", "_place", "_before")
