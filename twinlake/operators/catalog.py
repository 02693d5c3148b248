"""The entity catalog: upsert of a listing with change detection and move relinking, relocation, quarantine and migrations.

Catalog rows have path, size, date_created, date_modified, os_hash and features; whether a file exists is a column of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, text
from . import scope


def upsert(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """path and status of every path of either side: new, unchanged, touched (dates differ but the content hash agrees), changed, or
    missing.  One full outer join on the path."""
    c, s = catalog.alias("c"), listing.alias("s")
    j = c.join(s, F.col("c.path") == F.col("s.path"), "full_outer")
    dated = (F.col("c.date_created") == F.col("s.date_created")) & (F.col("c.date_modified") == F.col("s.date_modified"))
    status = (
        F.when(F.col("c.path").isNull(), "new")
        .when(F.col("s.path").isNull(), "missing")
        .when(F.col("c.size") != F.col("s.size"), "changed")
        .when(dated, "unchanged")
        .when(F.col("c.os_hash") == F.col("s.os_hash"), "touched")
        .otherwise("changed")
    )
    return j.select(F.coalesce("c.path", "s.path").alias("path"), status.alias("status"))


def relink(new: DataFrame, missing: DataFrame) -> DataFrame:
    """old_path of each new path whose size and content hash one missing entry has, and only one.

    The first new path takes an entry; later ones of the same content are new."""
    key = ["size", "os_hash"]
    lone = missing.where("os_hash IS NOT NULL").groupBy(*key).agg(F.count("*").alias("n"), F.min("path").alias("old_path")).where("n = 1")
    first = new.where("os_hash IS NOT NULL").groupBy(*key).agg(F.min("path").alias("path"))
    found = first.join(lone, key).select("path", "old_path")
    return new.select("path").join(found, "path", "left")


def merge(catalog: DataFrame, listing: DataFrame, keep_missing: bool = True) -> DataFrame:
    """The catalog after a scan: listing columns for new and changed paths (features null), the catalog's features for the others.

    Both tables have path, size, date_created, date_modified, os_hash; the catalog also has feature columns."""
    features = [c for c in catalog.columns if c not in listing.columns and c != "file_exists"]
    state = upsert(catalog, listing)
    fresh = listing.join(state.where("status IN ('new', 'changed')"), "path", "left_semi")
    links = relink(fresh.join(catalog.select("path"), "path", "left_anti"), catalog.join(state.where("status = 'missing'"), "path", "left_semi"))
    old = catalog.select(F.col("path").alias("old_path"), *features)
    taken = fresh.join(links, "path", "left").join(old, "old_path", "left")
    seen = listing.join(state.where("status IN ('unchanged', 'touched')"), "path", "left_semi").join(catalog.select("path", *features), "path").withColumn("old_path", F.lit(None).cast("string"))
    out = taken.select(*listing.columns, *features, F.lit(True).alias("file_exists")).unionByName(seen.select(*listing.columns, *features, F.lit(True).alias("file_exists")))
    if keep_missing:
        gone = catalog.join(state.where("status = 'missing'"), "path", "left_semi").join(links.where("old_path IS NOT NULL").select(F.col("old_path").alias("path")), "path", "left_anti")
        out = out.unionByName(gone.select(*listing.columns, *features, F.lit(False).alias("file_exists")))
    return out


def relocate(missing: DataFrame, files: DataFrame, use_modified: bool = True, use_duration: bool = False) -> DataFrame:
    """path, new_path, confidence and candidates of each missing entry, by size, then modification within two seconds, then duration
    within half a second.  Counts by size decide first, so unique sizes never pair."""
    sizes = files.groupBy("size").agg(F.count("*").alias("n_size"), F.min("path").alias("only"))
    m = missing.join(sizes, "size", "left")
    many = m.where("n_size > 1").alias("m").join(files.alias("f"), F.col("m.size") == F.col("f.size"))
    keep = F.lit(True)
    if use_modified:
        keep = keep & text.near_in_time(F.col("m.date_modified"), F.col("f.date_modified"), 2)
    if use_duration:
        keep = keep & (F.abs(F.col("m.duration_s") - F.col("f.duration_s")) <= 0.5)
    left = many.where(keep).groupBy(F.col("m.path").alias("path")).agg(F.count("*").alias("n_left"), F.min("f.path").alias("found"))
    j = m.join(left, "path", "left")
    sure = "SizeModifiedDuration" if use_duration else "SizeAndModified" if use_modified else "SizeOnly"
    n = F.coalesce("n_left", F.lit(0))
    confidence = F.when(F.col("n_size").isNull(), "NotFound").when(F.col("n_size") == 1, "SizeOnly").when(n == 1, sure).when(n > 1, "Ambiguous").otherwise("NotFound")
    new_path = F.when(F.col("n_size") == 1, F.col("only")).when((F.col("n_size") > 1) & (n == 1), F.col("found"))
    return j.select("path", new_path.alias("new_path"), confidence.alias("confidence"), F.when(F.col("n_size") == 1, F.lit(1)).otherwise(n).cast("long").alias("candidates"))


def quarantine(entries: DataFrame, suspects: DataFrame) -> DataFrame:
    """Flags entries that a crashed run was working on, by its phase."""
    j = entries.join(suspects.groupBy("path").agg(F.max(F.col("phase") == "audio").alias("audio"), F.max(F.col("phase") != "audio").alias("frames")), "path", "left")
    flags = kernels.set_flag(F.col("flags"), scope.AUDIO_ERROR, F.coalesce("audio", F.lit(False)) | kernels.has_any(F.col("flags"), scope.AUDIO_ERROR))
    flags = kernels.set_flag(flags, scope.THUMBNAIL_ERROR, F.coalesce("frames", F.lit(False)) | kernels.has_any(F.col("flags"), scope.THUMBNAIL_ERROR))
    return j.withColumn("flags", flags).drop("audio", "frames")


def exclude(entries: DataFrame, paths: DataFrame, on: bool = True) -> DataFrame:
    hit = entries.join(paths.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    return hit.withColumn("flags", F.when(F.col("_hit"), kernels.set_flag(F.col("flags"), scope.EXCLUDED, F.lit(on))).otherwise(F.col("flags"))).drop("_hit")


def relocate_prefix(entries: DataFrame, old: str, new: str) -> DataFrame:
    return entries.withColumn("path", text.moved(F.col("path"), old, new)).withColumn("folder", text.moved(F.col("folder"), old, new))


def prune_ghosts(entries: DataFrame) -> DataFrame:
    return entries.where(~scope.is_ghost((F.size("frames") > 0) | (F.size("audio_fp") > 0)))


def _emptied(frames: str) -> Column:
    return F.filter(frames, lambda f: F.lit(False))


def clear_hashes(entries: DataFrame) -> DataFrame:
    """Entries as if never read: no facts, frames or fingerprint and none of the flags that reading sets; identity stays."""
    flags = scope.THUMBNAIL_ERROR | scope.METADATA_ERROR | scope.TOO_DARK | scope.NO_AUDIO | scope.AUDIO_ERROR | scope.SILENT
    kinds = {f.name: f.dataType for f in entries.schema.fields}
    out = {c: F.lit(None).cast(kinds[c]) for c in ("streams", "duration_s", "audio_fp") if c in kinds}
    return entries.withColumns(out | {"frames": _emptied("frames"), "flags": F.col("flags").bitwiseAND(F.lit(~flags))})


def _healed(entries: DataFrame) -> DataFrame:
    """Each fingerprint error gets one retry: its flag goes, and an empty fingerprint that no other flag explains is forgotten."""
    poisoned = kernels.has_any(F.col("flags"), scope.AUDIO_ERROR) & (F.size("audio_fp") == 0) & ~kernels.has_any(F.col("flags"), scope.NO_AUDIO | scope.SILENT)
    kept = F.when(~F.coalesce(poisoned, F.lit(False)), F.col("audio_fp"))
    return entries.withColumns({"audio_fp": kept, "flags": F.col("flags").bitwiseAND(F.lit(~scope.AUDIO_ERROR))})


def _images_reset(entries: DataFrame) -> DataFrame:
    """Frames and hashes of images go, with the darkness that they told; videos stay."""
    image = F.coalesce("is_image", F.lit(False))
    frames = F.when(image, _emptied("frames")).otherwise(F.col("frames"))
    return entries.withColumns({"frames": frames, "flags": F.when(image, F.col("flags").bitwiseAND(F.lit(~scope.TOO_DARK))).otherwise(F.col("flags"))})


#: version -> what brings a catalog of the version before to it; each may run again without effect, but for the images' reset, which
#: forgets what was read since.
MIGRATIONS = {
    1: _healed,
    2: lambda df: df.withColumn("frames", F.filter("frames", lambda f: F.length(f["gray"]) == 1024)),
    3: _images_reset,
}


def migrate(entries: DataFrame, version: int) -> DataFrame:
    for v in sorted(MIGRATIONS):
        if v > version:
            entries = MIGRATIONS[v](entries)
    return entries


def cached(entries: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("path", "size", "date_modified")) -> DataFrame:
    """Entries with their cached vectors, null where the file changed since."""
    return entries.join(cache, list(keys), "left")


def kept_cache(cache: DataFrame, entries: DataFrame) -> DataFrame:
    return cache.join(entries.select("path").distinct(), "path", "left_semi")


def roots_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("root").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if("done").alias("done"))


def middle_value(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The upper median of each group, by counting ranks (no group is gathered)."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_v", value).withColumns({"_r": F.row_number().over(w.orderBy("_v")), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col("_v").alias("median"))
