"""Candidate pairs: range joins as equi-joins on buckets, so no pair of far apart rows is ever made.

Spark plans a band predicate as a nested loop; here each row is given the logarithmic buckets that its band can reach, and rows meet by
bucket (and by any equal keys).  Buckets are shuffled, so adaptive execution splits a dense one.  Where truly all pairs are compared,
rows fall into blocks of bounded size and every two blocks meet once; vectors and hashes are then compared as matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from . import numbering


def _bucket(value: Column, ratio: float) -> Column:
    return F.floor(F.ln(value) / math.log(ratio)).cast("long")


def renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{suffix}") for c in df.columns))


def duration_band(entries: DataFrame, percent: float = 20, least: float = 0, most: float = 0, keys: tuple[str, ...] = (), value: str = "duration_s", order: str = "idx") -> DataFrame:
    """Pairs (columns with _a and _b, a before b in order) whose durations differ by at most either one's tolerance.

    A partner is within a factor of 1 + percent, so it lies in the same logarithmic bucket or a neighbour; a minimum tolerance widens
    short durations, which then meet in buckets of that many seconds."""
    df = entries.where(F.col(value) > 0)
    if percent > 0 and least <= 0:
        ratio = 1 + percent / 100
        own, reach = _bucket(F.col(value), ratio), 1
    else:
        width = max(least, most, 1.0) if percent <= 0 or most > 0 else None
        if width is None:
            # the tolerance is percent of the duration, but never under least: logarithmic above least / percent, flat below
            ratio, turn = 1 + percent / 100, least / (percent / 100)
            flat = F.floor(F.col(value) / least).cast("long")
            top = math.floor(turn / least)
            own = F.when(F.col(value) < turn, flat).otherwise(_bucket(F.col(value) / turn, ratio) + top)
            reach = 2
        else:
            own, reach = F.floor(F.col(value) / width).cast("long"), 1
    df = df.withColumn("_own", own)
    left = renamed(df, "a")
    right = renamed(df.withColumn("_bucket", F.explode(F.sequence(F.col("_own") - reach, F.col("_own") + reach))), "b")
    on = [F.col("_own_a") == F.col("_bucket_b"), *(F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    a, b = F.col(f"{value}_a"), F.col(f"{value}_b")
    limit = F.least(kernels.duration_tolerance(a, percent, least, most), kernels.duration_tolerance(b, percent, least, most))
    pairs = left.join(right, cond & (F.col(f"{order}_a") < F.col(f"{order}_b")) & (F.abs(a - b) <= limit))
    return pairs.drop("_own_a", "_own_b", "_bucket_b")


def duration_band_ids(entries: DataFrame, percent: float = 20, keys: tuple[str, ...] = (), value: str = "duration_s", order: str = "idx", cuts: int = 8, most: int = 128) -> DataFrame:
    """(order_a, order_b) of the pairs that ``duration_band`` gives for a tolerance of percent alone, in an order in which they pack well.

    Pairs are quadratic in the rows, so what they take when written decides. Rows of a narrow bucket (``cuts`` to a tolerance) that are
    neighbours in the order form blocks of at most ``most``, blocks meet by bucket, and each row of one meets the whole other in turn: a
    column is then runs of one number, the other repeats of one block, which Parquet and its codec shorten to a small part. Most blocks
    that meet are similar as a whole. Partitions keep their number, as their work is quadratic in what adaptive execution joins them by."""
    share, names = percent / 100, [f"{order}_a", f"{order}_b"]
    ratio = (1 + share) ** (1 / cuts) * (1 + 1e-9)  # so that rounding moves no partner beyond the last bucket
    df = entries.where(F.col(value) > 0).select(*keys, F.col(order).cast("long").alias("_id"), F.col(value).cast("double").alias("_value")).where("_id IS NOT NULL")
    group = [*keys, "_own"]
    df = df.withColumn("_own", _bucket(F.col("_value"), ratio)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy("_id")))
    rows = F.sort_array(F.collect_list(F.struct("_id", "_value")))
    blocks = df.groupBy(*group, F.floor((F.col("_nth") - 1) / most).alias("_block")).agg(rows.alias("_rows"), F.min("_id").alias("_least"), F.max("_id").alias("_most"))
    blocks = blocks.select(*group, F.col("_rows._id").alias("_ids"), F.col("_rows._value").alias("_values"), "_least", "_most")
    right = renamed(blocks.withColumn("_own", F.explode(F.sequence(F.col("_own") - cuts, F.col("_own") + cuts))), "b")
    cond = F.col("_least_a") < F.col("_most_b")
    for k in group:
        cond = cond & (F.col(f"{k}_a") == F.col(f"{k}_b"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            sides = [[_lists(batch.column(f"{c}_{side}")) for c in ("_ids", "_values")] for side in "ab"]
            for (a, x), (b, y) in zip(*(zip(*side, strict=True) for side in sides), strict=True):
                if a[-1] < b[0] and max(x.max() - y.min(), y.max() - x.min()) <= min(x.min(), y.min()) * share:
                    held.append((np.tile(a, len(b)), np.repeat(b, len(a))))
                else:
                    j, i = np.nonzero((a < b[:, None]) & (np.abs(x - y[:, None]) <= np.minimum(x * share, (y * share)[:, None])))
                    held.append((a[i], b[j]))
                n += len(held[-1][0])
                if n >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    met = renamed(blocks, "a").join(right, cond).select("_ids_a", "_values_a", "_ids_b", "_values_b")
    return met.mapInArrow(pairs, f"{names[0]} long, {names[1]} long")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of lists without nulls, as views."""
    at = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), at[1:-1] - at[0]) if len(column) else []


def partial_ratio(entries: DataFrame, least: float = 0.10, most: float = 0.95, keys: tuple[str, ...] = (), value: str = "duration_s") -> DataFrame:
    """(source, clip) pairs: columns with _src and _clip; the clip lasts at least ``least`` and less than ``most`` of a source of one
    second or more.  A clip looks up the logarithmic buckets (factor 2) that its sources can be in."""
    df = entries.where(F.col(value) > 0).withColumn("_own", _bucket(F.col(value), 2.0))
    reach = math.ceil(math.log2(1 / least)) + 1
    src = renamed(df.where(F.col(value) >= 1), "src")
    clip = renamed(df.withColumn("_bucket", F.explode(F.sequence(F.col("_own"), F.col("_own") + reach))), "clip")
    s, c = F.col(f"{value}_src"), F.col(f"{value}_clip")
    cond = (F.col("_own_src") == F.col("_bucket_clip")) & (c < s * F.lit(most)) & (c >= s * F.lit(least))
    for k in keys:
        cond = cond & (F.col(f"{k}_src") == F.col(f"{k}_clip"))
    return src.join(clip, cond).drop("_own_src", "_own_clip", "_bucket_clip")


def _pieces(bits: int) -> tuple[int, int, float]:
    """(pieces, bits by which a shared piece may differ, expected share of random pairs that meet) with the least share."""
    found = []
    for near in (0, 1):
        pieces = bits // (near + 1) + 1
        if pieces <= 64:
            wide = 64 / pieces
            found.append((pieces * (1 + near * wide) / 2**wide, pieces, near))
    share, pieces, near = min(found, default=(1.0, 64, 0))
    return pieces, near, share


def hash_pairs(entries: DataFrame, bits: int, hash_column: str = "phash", order: str = "idx") -> DataFrame:
    """Pairs (columns with _a and _b, a before b) of hashes that differ in at most so many bits, by multi-index hashing.

    64 bits fall into pieces; similar hashes have one in which they differ in at most ``near`` bits (pigeonhole), so one side looks up
    the values of its pieces and the other gives all values that near.  That is exact, and a pair is kept at its first such piece.
    Where pieces would be so short that they bring more than a twentieth of all pairs together, blocks of rows are compared instead."""
    pieces, near, share = _pieces(bits)
    if share > 0.05:
        found = compared(entries, order, {hash_column: "long"}, _near_hashes(hash_column, bits), "distance int")
        return found.join(renamed(entries, "a"), f"{order}_a").join(renamed(entries, "b"), f"{order}_b").drop("distance")
    bounds = [i * 64 // pieces for i in range(pieces + 1)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    spans = [range(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [signed(sum(1 << k for k in span)) for span in spans]
    long = lambda m: F.lit(m).cast("long")
    h = F.col(hash_column)
    values = lambda of: F.explode(F.array(*(F.struct(F.lit(i).alias("i"), h.bitwiseAND(long(masks[i])).bitwiseXOR(long(d)).alias("v")) for i, d in of)))
    left = renamed(entries.withColumn("_k", values([(i, 0) for i in range(pieces)])), "a")
    right = renamed(entries.withColumn("_k", values([(i, d) for i, span in enumerate(spans) for d in (0, *(signed(1 << k) for k in span if near))])), "b")
    x = F.col(f"{hash_column}_a").bitwiseXOR(F.col(f"{hash_column}_b"))
    first = F.coalesce(*(F.when(F.bit_count(x.bitwiseAND(long(m))) <= near, F.lit(i)) for i, m in enumerate(masks)))
    cond = (F.col("_k_a") == F.col("_k_b")) & (F.col(f"{order}_a") < F.col(f"{order}_b")) & (F.bit_count(x) <= bits) & (first == F.col("_k_a.i"))
    return left.join(right, cond).drop("_k_a", "_k_b")


def _in_blocks(entries: DataFrame, order: str, most: int) -> tuple[DataFrame, int]:
    """Adds _block, the row's place in the order divided by the rows of a block, and says how many blocks there are."""
    df = numbering.numbered(entries, [F.col(order)], "_nth")
    n = entries.count()
    rows = min(most, max(512, -(-n // 16)))
    return df.withColumn("_block", F.floor(F.col("_nth") / rows).cast("int")).drop("_nth"), max(1, -(-n // rows))


def block_pairs(entries: DataFrame, order: str = "idx", most: int = 4096) -> DataFrame:
    """All pairs (columns with _a and _b, a before b) of a table that has no usable key, for verdicts that are Columns.

    Rows fall into blocks of at most ``most`` in their order, and every two blocks meet once under a key of their own, so n rows are
    n / most * (n / most + 1) / 2 groups of bounded size, and no pair is made twice."""
    df, blocks = _in_blocks(entries, order, most)
    first = df.withColumn("_j", F.explode(F.sequence(F.col("_block"), F.lit(blocks - 1)))).withColumnRenamed("_block", "_i")
    second = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_block")))).withColumnRenamed("_block", "_j")
    pairs = renamed(first, "a").join(renamed(second, "b").hint("shuffle_hash"), (F.col("_i_a") == F.col("_i_b")) & (F.col("_j_a") == F.col("_j_b")) & (F.col(f"{order}_a") < F.col(f"{order}_b")))
    return pairs.drop("_i_a", "_i_b", "_j_a", "_j_b")


def compared(entries: DataFrame, order: str, columns: dict[str, str], similar: Callable[[pa.Table, pa.Table], tuple[np.ndarray, ...]], adds: str, most: int = 4096) -> DataFrame:
    """(order_a, order_b, added columns) of the pairs of which ``similar`` says so, two blocks of rows at a time.

    columns: those that it needs, with their types.  similar: of two blocks, the places in the first and in the second and the columns it
    adds.  Blocks are as in ``block_pairs``; no pair is a row unless it is similar."""
    df, blocks = _in_blocks(entries.select(F.col(order).cast("long").alias(order), *(F.col(c).cast(t).alias(c) for c, t in columns.items())), order, most)
    names = [x.split()[0] for x in adds.split(",")]

    def run(key: tuple, both: pa.Table) -> pa.Table:
        block = both.column("_block").to_numpy()
        left, right = (both.filter(pa.array(block == k.as_py())) for k in key)
        x, y, *more = similar(left, right)
        a, b = (t.column(order).to_numpy()[at] for t, at in ((left, x), (right, y)))
        keep = a < b
        return pa.table([pa.array(a[keep]), pa.array(b[keep]), *(pa.array(m[keep]) for m in more)], names=[f"{order}_a", f"{order}_b", *names])

    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    met = df.select("*", other).withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_other")
    return met.groupBy("_i", "_j").applyInArrow(run, f"{order}_a long, {order}_b long, {adds}")


def _near_hashes(column: str, bits: int) -> Callable[[pa.Table, pa.Table], tuple[np.ndarray, ...]]:
    def similar(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
        (x, at_x), (y, at_y) = ((t.column(column).drop_null().to_numpy().view(np.uint64), np.flatnonzero(t.column(column).is_valid().to_numpy())) for t in (left, right))
        out = []
        for a in range(0, len(x), 512):
            distance = np.bitwise_count(x[a : a + 512, None] ^ y[None])
            i, j = np.nonzero(distance <= bits)
            out.append((at_x[i + a], at_y[j], distance[i, j].astype(np.int32)))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    return similar


def _matrix(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and their places; null ones are left out."""
    whole = column.drop_null().combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    at = np.flatnonzero(column.is_valid().to_numpy())
    return (whole.flatten().to_numpy().reshape(len(at), -1).astype(kind), at) if len(at) else (np.zeros((0, 0), kind), at)


def vector_pairs(entries: DataFrame, least: float, vector: str = "q", order: str = "idx", scale: int = 127) -> DataFrame:
    """(order_a, order_b, dot) of all pairs of integer vectors whose cosine (dot / scale^2) is at least so much.

    Blocks are multiplied as matrices; up to a thousand dimensions a product of 8-bit vectors is exact in single precision."""

    def similar(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
        (x, at_x), (y, at_y) = (_matrix(t.column(vector), np.float64) for t in (left, right))
        if x.shape[1] * scale**2 < 1 << 24:
            x, y = x.astype(np.float32), y.astype(np.float32)
        out = [(np.zeros(0, np.int64),) * 3]
        for a in range(0, len(x) if len(y) else 0, 512):
            dot = x[a : a + 512] @ y.T
            i, j = np.nonzero(dot.astype(np.float64) / float(scale**2) >= least)
            out.append((at_x[i + a], at_y[j], dot[i, j].astype(np.int64)))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    return compared(entries, order, {vector: "array<int>"}, similar, "dot long")


def not_hard_linked(with_duration: bool = True) -> Column:
    same = (F.col("size_a") == F.col("size_b")) & (F.col("st_dev_a") == F.col("st_dev_b")) & (F.col("st_ino_a") == F.col("st_ino_b"))
    return ~(same & (F.col("duration_s_a") == F.col("duration_s_b"))) if with_duration else ~same
