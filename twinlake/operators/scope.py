"""Which entries take part: ordered validity gates with a reason, eligibility, folder scopes and exclusion summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, text

#: Fixed values.  Bits of an entry's flags.
IS_IMAGE, EXCLUDED, THUMBNAIL_ERROR, METADATA_ERROR, TOO_DARK, NO_AUDIO, AUDIO_ERROR, SILENT, REPARSE, REPARSE_CHECKED = (1 << i for i in range(10))
ALL_ERRORS = THUMBNAIL_ERROR | METADATA_ERROR | TOO_DARK
FLAG_NAMES = {"IsImage": 1, "ManuallyExcluded": 2, "ThumbnailError": 4, "MetadataError": 8, "TooDark": 16, "NoAudioTrack": 32, "AudioFingerprintError": 64, "SilentAudioTrack": 128}


@dataclass(frozen=True)
class Scope:
    include: list[str] = field(default_factory=list)
    blacklist: list[str] = field(default_factory=list)
    recursive: bool = True
    images: bool = True
    missing_files: bool = False
    reparse_points: bool = True
    size_mb: tuple[int, int] | None = None
    must_match: list[str] = field(default_factory=list)
    must_not_match: list[str] = field(default_factory=list)


def included(folder: Column, roots: list[str], recursive: bool = True) -> Column:
    out = F.lit(not roots)
    for r in roots:
        out = out | text.under(folder, r, recursive)
    return out


def _matcher(regex: str) -> Callable[[Column], Column]:
    return lambda s: s.rlike(regex)


def blacklisted(folder: Column, entries: list[str]) -> Column:
    """An entry without wildcards is a folder and all below it; with them it is matched against each segment, or, if it holds a
    slash, against the whole folder."""
    out, segments = F.lit(False), F.split(folder, "/")
    for e in entries:
        if not set(e) & set("*?"):
            out = out | text.under(F.lower(folder), e.lower())
        elif "/" in e:
            out = out | folder.rlike(text.glob_regex(e))
        else:
            out = out | F.exists(segments, _matcher(text.glob_regex(e)))
    return out


def exclusion(scope: Scope) -> Column:
    """The reason of the first gate that an entry fails, null if it passes all."""
    flags, folder = F.col("flags"), F.col("folder")
    gates = [
        ("images are disabled", F.col("is_image") if not scope.images else F.lit(False)),
        ("folder is blacklisted", blacklisted(folder, scope.blacklist)),
        ("outside the included folders", ~included(folder, scope.include, scope.recursive)),
        ("manually excluded", kernels.has_any(flags, EXCLUDED)),
        ("too dark", kernels.has_any(flags, TOO_DARK)),
        ("file is missing", ~F.col("file_exists") if not scope.missing_files else F.lit(False)),
        ("path isn't valid text", ~F.is_valid_utf8("path")),
        ("size is out of range", ~text.megabytes(F.col("size")).between(*scope.size_mb) if scope.size_mb else F.lit(False)),
        ("path matches no required pattern", ~text.matches_any(F.col("path"), scope.must_match) if scope.must_match else F.lit(False)),
        ("reparse point", kernels.has_any(flags, REPARSE) if not scope.reparse_points else F.lit(False)),
        ("path matches a forbidden pattern", text.matches_any(F.col("path"), scope.must_not_match)),
    ]
    return F.coalesce(*(F.when(failed, F.lit(reason)) for reason, failed in gates))


def valid(entries: DataFrame, scope: Scope) -> DataFrame:
    return entries.where(exclusion(scope).isNull())


def eligible(entries: DataFrame, positions: int) -> DataFrame:
    """Entries with media information, without an error, and with enough frames."""
    return entries.where(F.col("has_info") & ~kernels.has_any(F.col("flags"), THUMBNAIL_ERROR) & (F.size("frames") >= positions))


def exclusion_summary(entries: DataFrame, scope: Scope, first: int = 5) -> DataFrame:
    """Number and first paths by reason.  Paths are cut to the first few before they are gathered."""
    df = entries.withColumn("reason", exclusion(scope)).where("reason IS NOT NULL")
    counts = df.groupBy("reason").agg(F.count("*").alias("n"))
    # the least few of each part first, so a common reason doesn't meet in one task
    part = Window.partitionBy("reason", F.pmod(F.xxhash64("path"), F.lit(64))).orderBy("path")
    some = df.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= first)
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("reason").orderBy("path"))).where(F.col("_n") <= first)
    return counts.join(some.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("examples")), "reason")


def folder_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def folder_gate(a: Column, b: Column, mode: str, depth: int = 1) -> Column:
    """none, same or different: by the last ``depth`` segments of two folders."""
    if mode == "none":
        return F.lit(True)
    same = text.last_segments(a, depth) == text.last_segments(b, depth)
    return same if mode == "same" else ~same


def flag_histogram(entries: DataFrame) -> DataFrame:
    """Entries by flag, and those with any error, in one pass."""
    return entries.agg(*(F.count_if(kernels.has_any(F.col("flags"), m)).alias(n) for n, m in FLAG_NAMES.items()), F.count_if(kernels.has_any(F.col("flags"), ALL_ERRORS)).alias("errors"))


def is_ghost(needs: Column) -> Column:
    """Missing on a drive that is there, and nothing to compare it by."""
    return ~F.col("file_exists") & F.col("root_ready") & ~needs


def presence(entries: DataFrame) -> DataFrame:
    return entries.withColumn("presence", F.when(F.col("file_exists"), "live").when(F.col("root_ready"), "tombstone").otherwise("offline"))


def cleaned(entries: DataFrame, scope: Scope, keep_tombstones: bool = False) -> DataFrame:
    """The catalog without missing entries and those outside the scope; tombstones may stay."""
    inside = included(F.col("folder"), scope.include, scope.recursive) & ~blacklisted(F.col("folder"), scope.blacklist)
    tomb = ~F.col("file_exists") & (F.size("frames") > 0) if keep_tombstones else F.lit(False)
    return entries.where(inside & (F.col("file_exists") | ~F.col("root_ready") | tomb))


def edit_filter(entries: DataFrame, kind: str | None = None, errors_only: bool = False, flag: int = 0, needle: str = "") -> DataFrame:
    keep = F.lit(True)
    if kind:
        keep = keep & (F.col("is_image") if kind == "image" else ~F.col("is_image"))
    if errors_only:
        keep = keep & kernels.has_any(F.col("flags"), ALL_ERRORS)
    if flag:
        keep = keep & kernels.has_any(F.col("flags"), flag)
    return entries.where(keep & F.lower("path").contains(needle.lower()) if needle else keep)


def needs_fingerprint() -> Column:
    return F.col("audio_fp").isNull() & ~kernels.has_any(F.col("flags"), NO_AUDIO | AUDIO_ERROR | SILENT) & ~F.col("is_image")


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path's longest root on a segment boundary: every prefix of a path is looked up, so no pair of path and root is tried."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = paths.select("path", F.explode(prefixes).alias("root")).join(roots.select("root"), "root")
    best = each.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")


def too_dark(sampled: DataFrame, percent: int = 80) -> DataFrame:
    """path and too_dark of each file with newly sampled frames (path, gray as an array of levels): all of them are dark.

    A file without new frames has no row, so its flag stays as it is."""
    return sampled.where("gray IS NOT NULL").groupBy("path").agg(F.bool_and(kernels.is_dark(F.col("gray"), percent)).alias("too_dark"))
