"""Similarity kernels as Column expressions: all of them stay in the JVM.

Vectors and frames are ``array<int>``; hashes are ``bigint`` (only their bits count); thresholds become integers on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.  Grey levels: at most this is black, at least this is white; the scale of a difference.
BLACK, WHITE, SCALE = 0x20, 0xF0, 256


def _sum(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def quantize(vector: Column) -> Column:
    """Unit vector -> integers in -127..127, halves to even."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") * 127).cast("int"))))


def int_dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("long") * y))


def int8_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), int_dot(a, b) / F.lit(16129.0)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def max_bits(percent: float, strict: bool = True) -> int:
    """Differing bits of 64 that a similarity allows."""
    return math.floor((1 - percent) * 64 + 1e-6) if strict else round((1 - percent) * 64)


def hamming_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - hamming(a, b) / F.lit(64.0)


def median_hash(values: Column) -> Column:
    """64 numbers -> the bits of those above their median (the mean of the 32nd and 33rd)."""
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("i"), F.slice(F.array_sort(values), 32, 2).alias("m"))  # sorted once
    above = lambda s, x: F.when(x * 2 > F.get(s["m"], F.lit(0)) + F.get(s["m"], F.lit(1)), F.expr("1L")).otherwise(F.expr("0L"))
    return F.aggregate(values, start, lambda s, x: F.struct(s["h"].bitwiseOR(F.call_function("shiftleft", above(s, x), s["i"])).alias("h"), (s["i"] + 1).alias("i"), s["m"].alias("m")))["h"]


def sign_bits(values: Column) -> Column:
    """Bit i is set where component i (of at most 64) is negative."""
    return F.aggregate(values, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("i")), lambda s, x: F.struct(s["h"].bitwiseOR(F.call_function("shiftleft", F.when(x < 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), s["i"])).alias("h"), (s["i"] + 1).alias("i")))["h"]


def sign_words(values: Column, dimensions: int = 384) -> Column:
    """The sign bits of the first ``dimensions`` components, 64 to a word; components that aren't there set no bit."""
    starts = F.array(*(F.lit(k) for k in range(0, dimensions, 64)))
    return F.transform(starts, lambda k: sign_bits(F.slice(values, k + 1, F.least(F.lit(64), F.lit(dimensions) - k))))


def words_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signatures of as many words."""
    return _sum(F.zip_with(a, b, lambda x, y: hamming(x, y).cast("long")))


def signature_bound(dimensions: int, threshold: float) -> int:
    """Differing sign bits that pairs of that cosine or more stay below, but for some in a million."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(dimensions * p + 4.6 * math.sqrt(dimensions * p * (1 - p)))


def gray_sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two frames."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")))


def gray_difference(a: Column, b: Column) -> Column:
    return gray_sad(a, b) / F.size(a) / F.lit(float(SCALE))


def masked_difference(a: Column, b: Column, black: bool = True, white: bool = True) -> Column:
    """Difference over pixels that are black (white) in neither frame; null, so no match, if none is left."""
    lost = lambda x: (x <= BLACK if black else F.lit(False)) | (x >= WHITE if white else F.lit(False))
    kept = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: ~lost(p["a"]) & ~lost(p["b"]))
    total = _sum(F.transform(kept, lambda p: F.abs(p["a"] - p["b"]).cast("long")))
    return F.when(F.size(kept) > 0, total / F.size(kept) / F.lit(float(SCALE)))


def flip(frame: Column, side: int) -> Column:
    """A square frame mirrored left to right."""
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.element_at(frame, (i - i % side + (side - 1) - i % side + 1).cast("int")))


def dark_percent(frame: Column) -> Column:
    return 100 * F.size(F.filter(frame, lambda x: x <= BLACK)) / F.size(frame)


def is_dark(frame: Column, percent: int = 80) -> Column:
    return dark_percent(frame) >= percent


def quorum_needed(positions: int, ratio: float) -> int:
    return max(1, math.ceil(positions * max(0.01, min(1.0, ratio))))


def hash_quorum(a: Column, b: Column, positions: int, bits: int, ratio: float = 0.6) -> tuple[Column, Column]:
    """(enough positions agree, mean dissimilarity over all positions) of two arrays of hashes."""
    distance = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    agreeing = F.size(F.filter(distance, lambda d: d <= bits))
    return agreeing >= quorum_needed(positions, ratio), _sum(distance) / F.lit(64.0 * positions)


def mean_cosine(a: Column, b: Column, positions: int) -> Column:
    """Mean cosine over positions that both have; null (abstain) if fewer than half of them."""
    both = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    total = _sum(F.transform(both, lambda p: int_dot(p["a"], p["b"])))
    return F.when(F.size(both) >= max(1, (positions + 1) // 2), total / F.size(both) / F.lit(16129.0))


def duration_tolerance(duration: Column, percent: float = 20, least: float = 0, most: float = 0) -> Column:
    """Seconds by which a partner's duration may differ."""
    if percent <= 0:
        return F.lit(float(least))
    own = duration * F.lit(percent / 100)
    own = F.greatest(own, F.lit(float(least))) if least > 0 else own
    return F.least(own, F.lit(float(most))) if most > 0 else own


def sampling_interval(duration: Column) -> Column:
    """Seconds between frames of a timeline: a sixtieth within 5 to 15, and 400 frames at most."""
    return F.greatest(F.least(F.greatest(duration / 60, F.lit(5.0)), F.lit(15.0)), duration / 400)


def sliding_window(shorter: Column, longer: Column, num: int, den: int) -> Column:
    """The offset at which 32-bit blocks differ least (the first on ties), struct(bits, offset); null if more than (den - num) / den
    of all bits differ everywhere.  Integer budgets, so a window at exactly the limit passes."""
    offsets = F.sequence(F.lit(0), F.size(longer) - F.size(shorter))
    bits = lambda o: _sum(F.zip_with(shorter, F.slice(longer, o + 1, F.size(shorter)), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")))
    best = F.array_min(F.transform(offsets, lambda o: F.struct(bits(o).alias("bits"), o.alias("offset"))))
    return F.when((F.size(longer) >= F.size(shorter)) & (best["bits"] * den <= (den - num) * 32 * F.size(shorter)), best)


def has_any(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def has_all(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def set_flag(flags: Column, mask: int, on: Column) -> Column:
    return F.when(on, flags.bitwiseOR(F.lit(mask))).otherwise(flags.bitwiseAND(F.lit(~mask)))


def is_silent(fingerprint: Column) -> Column:
    """A fingerprint with blocks, all of them zero (null and empty fingerprints aren't silent)."""
    return F.coalesce((F.size(fingerprint) > 0) & F.forall(fingerprint, lambda x: x == 0), F.lit(False))
