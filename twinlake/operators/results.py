"""Result lists: filters, group headers, sorting, totals, blacklists and dry-run reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text
from . import numbering



def group() -> WindowSpec:
    """The rows of a group."""
    return Window.partitionBy("group_id")


FLIPPED, PARTIAL, AI, GRAY, PHASH = 1, 2, 4, 8, 16


def _chosen(streams: Column, kind: str, size: Callable[[Column], Column]) -> Column:
    """The stream of a kind with the largest size, the first of equal ones; an unknown size counts as 0."""
    sized = F.transform(streams, lambda s, i: F.struct(F.when(F.lower(s["codec_type"]) == kind, F.coalesce(size(s), F.lit(0).cast("long"))).alias("size"), (-i).alias("place"), s.alias("stream")))
    return F.array_max(F.filter(sized, lambda x: x["size"] >= 0))["stream"]


def projected(members: DataFrame) -> DataFrame:
    """Result rows of entries that belong to groups: the facts of the video stream with most pixels and of the audio stream with most
    channels, of an image the size of its first stream and its file's ending as format.

    members: the columns of an entry, with group_id, difference and match_flags.  Without streams, texts are null and numbers are 0."""
    image = F.coalesce("is_image", F.lit(False))
    film = ~image & F.coalesce(F.size("streams") > 0, F.lit(False))
    area = lambda s: s["width"].cast("long") * s["height"]
    df = members.withColumn("_video", F.when(film, _chosen(F.col("streams"), "video", area))).withColumn("_audio", F.when(film, _chosen(F.col("streams"), "audio", lambda s: s["channels"].cast("long"))))
    df = df.withColumn("_shown", F.when(image, F.get("streams", F.lit(0))).otherwise(F.col("_video")))
    number = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind))
    name = lambda c, of: F.when(F.col(of).isNotNull(), F.coalesce(F.col(c), F.lit("<Unknown>")))
    ending = F.nullif(F.regexp_extract("path", r"\.([^./\\]*)$", 1), F.lit(""))
    hdr = F.when(F.col("_video").isNotNull(), F.coalesce("_video.hdr_format", F.lit("")))
    return df.select(
        "group_id",
        "path",
        "folder",
        "size",
        ((1 - F.col("difference")) * 100).alias("similarity"),
        F.when(film, F.col("duration_s")).otherwise(0.0).alias("duration_s"),
        F.when(F.col("_shown").isNotNull(), F.concat_ws("x", number("_shown.width", "int"), number("_shown.height", "int"))).alias("frame_size"),
        (number("_shown.width", "int") + number("_shown.height", "int")).alias("frame_size_int"),
        F.when(image, ending).otherwise(name("_video.codec_name", "_video")).alias("format"),
        number("_video.frame_rate", "float").cast("double").alias("fps"),
        text.kilobits(number("_video.bit_rate", "bigint")).alias("bitrate_kbs"),
        name("_audio.codec_name", "_audio").alias("audio_format"),
        name("_audio.channel_layout", "_audio").alias("audio_channel"),
        number("_audio.sample_rate", "int").alias("sample_rate"),
        text.kilobits(number("_audio.bit_rate", "bigint")).alias("audio_bitrate_kbs"),
        hdr.alias("hdr_format"),
        text.hdr_rank(hdr).alias("hdr_rank"),
        "date_created",
        image.alias("is_image"),
        F.col("match_flags").alias("flags"),
    )


def headers(items: DataFrame) -> DataFrame:
    """One row for each group: sizes (negative ones as 0), similarity range, and what it has."""
    size = F.greatest("size", F.lit(0).cast("long"))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return items.groupBy("group_id").agg(
        F.count("*").alias("file_count"),
        F.sum(size).alias("total_bytes"),
        (F.sum(size) - F.max(size)).alias("wasted_bytes"),
        F.max(size).alias("largest"),
        F.min("similarity").alias("similarity_min"),
        F.max("similarity").alias("similarity_max"),
        F.count_if("file_exists").alias("on_disk"),
        has(~F.col("file_exists") & F.col("root_ready")).alias("has_tombstone"),
        has(~F.col("root_ready")).alias("has_offline"),
        has(F.col("checked")).alias("has_checked"),
        has(F.col("flags").bitwiseAND(F.lit(GRAY)) != 0).alias("has_grayscale"),
        has(F.col("flags").bitwiseAND(F.lit(PHASH)) != 0).alias("has_phash"),
        F.max("date_created").alias("newest"),
        F.max("duration_s").alias("longest"),
        F.max("frame_size_int").alias("largest_frame"),
        F.min_by("path", "seq").alias("first_path"),
    )


#: mode -> sort key of a header
SORTS = {"WastedSpace": "wasted_bytes", "TotalSize": "total_bytes", "LargestFile": "largest", "FileCount": "file_count", "Similarity": "similarity_max", "DateCreated": "newest", "Duration": "longest", "Resolution": "largest_frame", "FolderPath": "lower_path", "GroupsWithCheckedItems": "has_checked"}


def sorted_headers(head: DataFrame, mode: str, descending: bool = True) -> DataFrame:
    """Headers in order, ties by first appearance (the group's id).  Numbers come with ``numbered``."""
    key = F.lower("first_path") if mode == "FolderPath" else F.col(SORTS[mode])
    return head.orderBy(key.desc() if descending else key.asc(), "group_id")


def numbered(head: DataFrame, mode: str, descending: bool = True) -> DataFrame:
    """Adds group_no, from 1 in sort order."""
    key = F.lower("first_path") if mode == "FolderPath" else F.col(SORTS[mode])
    return numbering.numbered(head, [key.desc() if descending else key.asc(), F.col("group_id").asc()], "group_no", first=1)


MEMBER_SORTS = {"similarity": "similarity", "size": "size", "duration": "duration_s", "bitrate": "bitrate_kbs", "resolution": "frame_size_int", "date": "date_created", "name": "path"}


def member_order(items: DataFrame, mode: str, descending: bool = True, best_first: Column | None = None) -> DataFrame:
    """Adds nth, each row's place in its group; ties in the rows' own order."""
    key = F.lower("path") if mode == "name" else F.col(MEMBER_SORTS[mode])
    first = [best_first.cast("int").desc()] if best_first is not None else []
    return items.withColumn("nth", F.row_number().over(group().orderBy(*first, key.desc() if descending else key.asc(), "seq")))


def visible(items: DataFrame, needle: str | None = None, kind: str | None = None, similarity: tuple[float, float] = (0, 100), checked_groups: bool = False, least: int = 2) -> DataFrame:
    """Rows that pass the filter: the path (or another of its group) matches, kind, similarity range; groups left with fewer than
    ``least`` rows go."""
    keep = F.col("similarity").between(*similarity)
    if kind:
        keep = keep & (F.col("is_image") if kind == "image" else ~F.col("is_image"))
    df = items
    if needle:
        hit = F.col("path").rlike(text.glob_regex(needle, whole=False)) if set(needle) & set("*?") else F.lower("path").contains(needle.lower())
        df = df.withColumn("_hit", F.max(hit).over(group()))
        keep = keep & F.col("_hit")
    if checked_groups:
        df = df.withColumn("_some", F.max("checked").over(group()))
        keep = keep & F.col("_some")
    return df.where(keep).withColumn("_n", F.count("*").over(group())).where(F.col("_n") >= least).select(*items.columns)


def hit_groups(items: DataFrame, needle: str) -> DataFrame:
    """All rows of groups of which one has the needle in its path."""
    return items.join(items.where(F.lower("path").contains(needle.lower())).select("group_id").distinct(), "group_id", "left_semi")


def statistics(items: DataFrame) -> DataFrame:
    each = items.groupBy("group_id").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("groups"), F.sum("n").alias("items"), F.avg("n").alias("mean"), F.max("n").alias("largest"), F.count_if(F.col("n") > 5).alias("over_5"), F.count_if(F.col("n") > 10).alias("over_10"))


def totals(items: DataFrame) -> DataFrame:
    size = F.greatest("size", F.lit(0).cast("long"))
    each = items.groupBy("group_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("most"))
    return each.agg(F.sum("n").alias("items"), F.count("*").alias("groups"), F.sum("bytes").alias("total_bytes"), F.sum(F.col("bytes") - F.col("most")).alias("savings"))


def checked_summary(items: DataFrame) -> DataFrame:
    mine = items.where("checked")
    return mine.agg(F.count("*").alias("checked"), F.coalesce(F.sum(F.greatest("size", F.lit(0).cast("long"))), F.lit(0).cast("long")).alias("checked_bytes"), F.count_distinct("group_id").alias("groups_with_checked"))


def contributions(items: DataFrame) -> DataFrame:
    """Rows that grey frames, hashes or both matched."""
    g, p = F.col("flags").bitwiseAND(F.lit(GRAY)) != 0, F.col("flags").bitwiseAND(F.lit(PHASH)) != 0
    return items.agg(F.count_if(g & p).alias("both"), F.count_if(g & ~p).alias("gray_only"), F.count_if(~g & p).alias("phash_only"))


def all_equal(items: DataFrame, columns: list[str]) -> DataFrame:
    return items.groupBy("group_id").agg(*((F.count_distinct(c) <= 1).alias(f"{c}_equal") for c in columns))


def redownloads(items: DataFrame) -> DataFrame:
    """Live rows of groups that hold a tombstone (deleted content that is remembered)."""
    tomb = ~F.col("file_exists") & F.col("root_ready")
    return items.withColumn("_tomb", F.max(tomb).over(group())).where(F.col("_tomb") & F.col("file_exists")).drop("_tomb")


def drop_hard_links(items: DataFrame) -> DataFrame:
    """Keeps the first of rows that are one file on disk; groups left with one row go."""
    w = Window.partitionBy("group_id", "size", "st_dev", "st_ino").orderBy("seq")
    kept = items.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return kept.withColumn("_n", F.count("*").over(group())).where("_n >= 2").drop("_n")


def drop_blacklisted(items: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Groups all of whose paths are in one blacklist set go: relational division by a count."""
    paths = blacklist.select("bl_id", F.explode("paths").alias("path")).distinct()
    members = items.select("group_id", "path").distinct()
    total = members.groupBy("group_id").agg(F.count("*").alias("n"))
    covered = members.join(paths, "path").groupBy("group_id", "bl_id").agg(F.count("*").alias("k")).join(total, "group_id").where("k = n").select("group_id").distinct()
    return items.join(covered, "group_id", "left_anti")


def prune_blacklist(blacklist: DataFrame, present: DataFrame) -> DataFrame:
    """Blacklist sets all of whose paths are present."""
    each = blacklist.select("bl_id", F.explode("paths").alias("path")).join(present.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    whole = each.groupBy("bl_id").agg(F.bool_and(F.col("_there").isNotNull()).alias("whole")).where("whole").select("bl_id")
    return blacklist.join(whole, "bl_id", "left_semi")


def cleanup_report(items: DataFrame) -> DataFrame:
    """Dry run: for each group with marked rows, how many go, how many stay, and the bytes saved."""
    size = F.greatest("size", F.lit(0).cast("long"))
    each = items.groupBy("group_id").agg(F.count_if("checked").alias("remove"), F.count_if(~F.col("checked")).alias("keep"), F.coalesce(F.sum(F.when(F.col("checked"), size)), F.lit(0).cast("long")).alias("savings"))
    return each.where("remove > 0")


ACTIONS = ("delete", "trash", "move", "symlink", "hardlink")


def action_plan(items: DataFrame, action: str, target_folder: str = "") -> DataFrame:
    """path, action, target of every marked row; nothing is touched.  Links point at the largest unmarked row of the group, and a group
    without one isn't linked."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    keeper = F.max(F.when(~F.col("checked"), F.struct("size", (-F.col("seq")).alias("s"), "path"))).over(group())["path"]
    target = {"move": F.concat(F.lit(target_folder.rstrip("/") + "/"), text.file_name(F.col("path"))), "symlink": F.col("_keeper"), "hardlink": F.col("_keeper")}.get(action, F.lit(None).cast("string"))
    plan = items.withColumn("_keeper", keeper).where("checked").select("group_id", "path", F.lit(action).alias("action"), target.alias("target"))
    return plan.where("target IS NOT NULL") if action in ("symlink", "hardlink") else plan


def log_rows(log: DataFrame, key: Column | None = None, severity: str | None = None, search: str | None = None) -> DataFrame:
    """Collapses repeats: a row for each session, severity and message shape with its count, first place and first message.

    ``severity`` leaves entries of that severity only; ``search`` leaves rows of which some entry's message holds it, in any case.

    Sessions are numbered by a running sum over the log's order, taken over ranges so that no task reads the whole log."""
    df = numbering.ranged(log, [F.col("seq")])
    before = numbering.before(df, F.count_if("is_session_start"), "_before")
    session = F.count_if("is_session_start").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_local", session).join(F.broadcast(before), "_part").withColumn("session", F.col("_before") + F.col("_local"))
    key = text.message_key(F.col("message")) if key is None else key
    if severity:
        df = df.where(F.col("severity") == severity)
    found = F.bool_or(F.lower("message").contains(search.lower())) if search and search.strip() else F.lit(True)
    each = df.groupBy("session", "severity", key.alias("key")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.min_by("message", "seq").alias("message"), found.alias("_found"))
    return each.where("_found").drop("_found")
