"""The whole comparison: a catalog in, groups of duplicates with their best flags out, and what to delete.

Entries are catalog rows (``sources.schema.MEDIA_ENTRY``) whose frames are arrays of numbers (``frames: array<array<int>>``), with
optional ``hashes`` (array<bigint>) and ``vectors`` (array<array<int>>).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import candidates, grouping, numbering, partial, rank, scope, verdict


@dataclass(frozen=True)
class Settings:
    scope: scope.Scope = field(default_factory=scope.Scope)
    matching: verdict.Matching = field(default_factory=verdict.Matching)
    duration_percent: float = 20
    duration_least: float = 0
    duration_most: float = 0
    folders: str = "none"
    folder_depth: int = 1
    skip_hard_links: bool = True
    budget: int = 131_000
    partial_audio: bool = False
    partial_least: float = 0.10
    partial_similarity: tuple[int, int] = (4, 5)


def eligible(entries: DataFrame, s: Settings) -> DataFrame:
    """Entries that take part, numbered by path."""
    ok = scope.valid(entries, s.scope).where(~kernels.has_any(F.col("flags"), scope.THUMBNAIL_ERROR))
    return numbering.numbered(verdict.snapshot(ok, s.matching), [F.col("path")], "idx")


def pairs(snapshot: DataFrame, s: Settings) -> DataFrame:
    """Candidate pairs: images among themselves, videos by duration; then the folder rule and hard links.

    With the rule "same folder" the folder is a join key, so other pairs never arise."""
    df, keys = snapshot, ()
    if s.folders == "same":
        from ..functions import text

        df, keys = df.withColumn("_folder", text.last_segments(F.col("folder"), s.folder_depth)), ("_folder",)
    videos = candidates.duration_band(df.where("NOT is_image"), s.duration_percent, s.duration_least, s.duration_most, keys)
    images = candidates.block_pairs(df.where("is_image"))
    both = videos.unionByName(images)
    both = both.where(scope.folder_gate(F.col("folder_a"), F.col("folder_b"), s.folders, s.folder_depth))
    if s.skip_hard_links:
        linked = candidates.not_hard_linked(with_duration=False) | (~F.col("is_image_a") & (F.col("duration_s_a") != F.col("duration_s_b")))
        both = both.where(linked)
    return both


def edges(snapshot: DataFrame, s: Settings) -> DataFrame:
    """Verdicts of all pairs that groups need: those emitted, and within each component the plain verdict of all pairs (without gates)."""
    m, image = s.matching, F.col("is_image_a")
    found = verdict.judged(pairs(snapshot, s), m, image).where("similar").select(F.col("idx_a").alias("a"), F.col("idx_b").alias("b"), "difference", "flags")
    found = grouping.checkpoint(found)
    label = grouping.components(found)
    inside = label.withColumnRenamed("node", "idx").join(snapshot, "idx")
    all_ = candidates.renamed(inside, "a").join(candidates.renamed(inside, "b"), (F.col("component_a") == F.col("component_b")) & (F.col("idx_a") < F.col("idx_b")))
    plain = all_.withColumn("_p", verdict.plain(m, image)).select(F.col("idx_a").alias("a"), F.col("idx_b").alias("b"), F.col("_p.similar").alias("plain"))
    joined = plain.join(found.withColumn("emitted", F.lit(True)), ["a", "b"], "full_outer")
    return joined.select("a", "b", F.coalesce("difference", F.lit(0.0)).alias("difference"), F.coalesce("flags", F.lit(0)).alias("flags"), F.coalesce("emitted", F.lit(False)).alias("emitted"), F.coalesce("plain", F.lit(False)).alias("plain"))


def compare(entries: DataFrame, s: Settings) -> DataFrame:
    """Duplicate items: group_id, seq, path, similarity, flags and the entry's facts, with best flags."""
    snap = grouping.checkpoint(eligible(entries, s))
    members = grouping.groups(edges(snap, s), split_budget=s.budget)
    facts = snap.drop("frames", "frames_flip", "hashes", "hashes_flip", "vectors", "flags")
    items = members.select("group_id", F.col("node").alias("idx"), F.col("joined").alias("seq"), ((1 - F.col("difference")) * 100).alias("similarity"), "flags", "skipped").join(facts, "idx")
    defaults = {"frame_size_int": F.lit(0), "fps": F.lit(0.0), "bitrate_kbs": F.lit(0), "audio_bitrate_kbs": F.lit(0), "hdr_rank": F.lit(0)}
    return rank.best_flags(items.withColumns({c: v for c, v in defaults.items() if c not in items.columns}))


def partial_clips(entries: DataFrame, grouped: DataFrame, s: Settings) -> DataFrame:
    """Clips whose audio lies in a longer, ungrouped video: rows of partial groups."""
    free = partial.ungrouped(scope.valid(entries, s.scope).where("NOT is_image AND size(audio_fp) >= 2"), grouped)
    met = candidates.partial_ratio(free.select("path", "folder", "duration_s", "audio_fp"), s.partial_least)
    met = met.where(scope.folder_gate(F.col("folder_src"), F.col("folder_clip"), s.folders, s.folder_depth))
    found = partial.audio_matches(met, *s.partial_similarity).withColumns({"source": F.col("path_src"), "clip": F.col("path_clip")})
    return partial.emitted(partial.assign(found, F.desc("duration_s_src")), verdict.PARTIAL)


def scan_and_compare(entries: DataFrame, s: Settings, strategy: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Items, and the rows that a strategy deletes."""
    items = grouping.checkpoint(compare(entries, s))
    return items, rank.deletions(items, strategy) if strategy else None
