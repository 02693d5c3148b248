"""Best flags, keepers, deletion strategies and selections within groups of duplicates, as window expressions.

Every operator takes rows with group_id and seq (the order of rows within a group) and never collects a group: one hash exchange by
group_id serves all windows of an operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F



def group() -> WindowSpec:
    """The rows of a group."""
    return Window.partitionBy("group_id")


#: best flag -> (column, smallest is best, also for images)
BEST = {"is_best_size": ("size", True, True), "is_best_duration": ("duration_s", False, False), "is_best_frame_size": ("frame_size_int", False, True), "is_best_fps": ("fps", False, False), "is_best_bitrate_kbs": ("bitrate_kbs", False, False), "is_best_audio_bitrate_kbs": ("audio_bitrate_kbs", False, False), "is_best_hdr_format": ("hdr_rank", False, False)}


def best_flags(items: DataFrame) -> DataFrame:
    """All rows that tie for the best value are flagged; images only by size and frame size."""
    flags = {}
    for flag, (column, least, images) in BEST.items():
        best = F.col(column) == (F.min if least else F.max)(column).over(group())
        flags[flag] = best if images else best & ~F.col("is_image")
    return items.withColumns(flags)


@dataclass(frozen=True)
class Criterion:
    """A step of the keeper cascade: the value, whether it is for videos only, whether less is better, and what counts as a tie."""

    name: str
    value: Column
    video_only: bool = False
    ascending: bool = False
    ties: Callable[[Column, Column], Column] = field(default=lambda a, b: a == b)


def bits_per_pixel() -> Column:
    pixels = F.col("width").cast("double") * F.col("height") * F.col("fps")
    return F.when((F.col("bitrate_kbs") > 0) & (pixels > 0), F.col("bitrate_kbs") * 1000 / pixels).otherwise(F.lit(0.0))


def within(share: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.abs(a - b) <= F.greatest(a, b) * share


def criteria() -> dict[str, Criterion]:
    duration = lambda a, b: (F.abs(a - b) <= 1) | (F.abs(a - b) <= F.greatest(a, b) * 0.01)
    rate = within(0.05)
    return {
        "Duration": Criterion("Duration", F.col("duration_s"), True, ties=duration),
        "Resolution": Criterion("Resolution", F.col("frame_size_int")),
        "Bitrate": Criterion("Bitrate", F.col("bitrate_kbs"), True, ties=rate),
        "FPS": Criterion("FPS", F.col("fps"), True, ties=lambda a, b: F.abs(a - b) <= 0.5),
        "Bits per pixel": Criterion("Bits per pixel", bits_per_pixel(), True, ties=rate),
        "Audio Bitrate": Criterion("Audio Bitrate", F.col("audio_bitrate_kbs"), True, ties=rate),
        "Size": Criterion("Size", F.col("size"), ascending=True),
    }


def web_criteria() -> list[Criterion]:
    """Without tolerances; its audio step reads the sample rate."""
    return [Criterion("Duration", F.col("duration_s"), True), Criterion("Resolution", F.col("frame_size_int")), Criterion("Bitrate", F.col("bitrate_kbs"), True), Criterion("FPS", F.col("fps"), True), Criterion("Audio Bitrate", F.col("sample_rate"), True), Criterion("Size", F.col("size"), ascending=True)]


def keepers(items: DataFrame, steps: list[Criterion]) -> DataFrame:
    """Adds is_keeper and decided_by (null if a tie was left to the order of rows).

    Ties with a tolerance aren't transitive, so this is a cascade: each step finds the best of those still alive (the first in order),
    and those tied with it stay.  A video step is skipped while the present keeper is an image."""
    df = items.withColumns({"_alive": F.lit(True), "_keep": F.min("seq").over(group()), "decided_by": F.lit(None).cast("string")})
    for c in steps:
        df = df.withColumn("_value", c.value)
        n = F.count_if(F.col("_alive")).over(group())
        keep_image = F.max(F.when(F.col("seq") == F.col("_keep"), F.col("is_image"))).over(group())
        df = df.withColumn("_runs", (n > 1) & (~keep_image if c.video_only else F.lit(True)))
        value = -F.col("_value") if c.ascending else F.col("_value")
        best = F.max(F.when(F.col("_alive"), F.struct(value.alias("v"), (-F.col("seq")).alias("s"), F.col("_value").alias("raw")))).over(group())
        df = df.withColumn("_best", best)
        df = df.withColumn("_tied", F.col("_alive") & c.ties(F.col("_value"), F.col("_best.raw")))
        left = F.count_if(F.col("_tied")).over(group())
        df = df.withColumns({"_left": left})
        df = df.withColumns({"_keep": F.when(F.col("_runs"), -F.col("_best.s")).otherwise(F.col("_keep")), "decided_by": F.coalesce("decided_by", F.when(F.col("_runs") & (F.col("_left") <= 1), c.name)), "_alive": F.when(F.col("_runs"), F.col("_tied") | ((F.col("_left") <= 1) & (F.col("seq") == -F.col("_best.s")))).otherwise(F.col("_alive"))})
    return df.withColumn("is_keeper", F.col("seq") == F.col("_keep")).drop("_alive", "_keep", "_value", "_runs", "_best", "_tied", "_left")


STRATEGIES = ["lowest-quality", "smallest-file", "shortest-duration", "worst-resolution", "100-percent-only"]


def strategy_name(text: str) -> str:
    """Any spelling of a strategy -> its name."""
    plain = "".join(c for c in text.lower() if c.isalnum()).replace("hundred", "100")
    for name in STRATEGIES:
        if name.replace("-", "") == plain:
            return name
    raise ValueError(f"unknown strategy {text!r}; known: {', '.join(STRATEGIES)}")


def deletions(items: DataFrame, strategy: str) -> DataFrame:
    """Rows that a strategy deletes: all but the keeper, in groups of two or more."""
    strategy = strategy_name(strategy)
    df = best_flags(items)
    by = {"smallest-file": [F.desc("size")], "shortest-duration": [F.desc("duration_s")], "worst-resolution": [F.desc("frame_size_int")]}.get(strategy)
    if by is None:
        some_rate, some_frame = (F.max(F.col(c)).over(group()) for c in ("is_best_bitrate_kbs", "is_best_frame_size"))
        df = df.withColumns({"_rate": some_rate, "_frame": some_frame})
        chosen = F.when(F.col("_rate"), F.col("is_best_bitrate_kbs")).when(F.col("_frame"), F.col("is_best_frame_size")).otherwise(F.lit(False))
        by = [F.desc(chosen.cast("int")), F.desc(F.when(F.col("_rate") | F.col("_frame"), 0).otherwise(F.col("bitrate_kbs"))), F.desc(F.when(F.col("_rate") | F.col("_frame"), 0).otherwise(F.col("frame_size_int"))), F.desc(F.when(F.col("_rate") | F.col("_frame"), 0).otherwise(F.col("size")))]
    df = df.withColumns({"_nth": F.row_number().over(group().orderBy(*by, "seq")), "_n": F.count("*").over(group()), "_least": F.min("similarity").over(group())})
    gone = (F.col("_n") >= 2) & (F.col("_nth") > 1)
    if strategy == "100-percent-only":
        gone = gone & (F.col("_least") >= 100)
    return df.where(gone).select(*items.columns)


AUTO = ["LowestQuality", "SmallestFile", "Oldest", "Newest", "HundredPercentEqual"]


def auto_select(items: DataFrame, mode: str) -> DataFrame:
    """Rows that the mode selects for deletion (Oldest selects all but the newest)."""
    df = items.withColumns({"_n": F.count("*").over(group()), "_least": F.min("similarity").over(group())})
    if mode == "LowestQuality":
        return keepers(items, web_criteria()).withColumn("_n", F.count("*").over(group())).where(~F.col("is_keeper") & (F.col("_n") >= 2)).select(*items.columns)
    order = {"SmallestFile": F.desc("size"), "Oldest": F.desc("date_created"), "Newest": F.asc("date_created"), "HundredPercentEqual": F.asc("seq")}[mode]
    df = df.withColumn("_nth", F.row_number().over(group().orderBy(order, "seq")))
    gone = (F.col("_nth") > 1) & (F.col("_n") >= 2)
    return df.where(gone & (F.col("_least") >= 100) if mode == "HundredPercentEqual" else gone).select(*items.columns)


#: Fixed values.  What makes rows of a group equal, by kind.
EQUALITY = {"full": ["size", "duration_s", "frame_size_int", "fps", "bitrate_kbs", "audio_bitrate_kbs", "is_image"], "but_size": ["duration_s", "frame_size_int", "fps", "is_image"], "group": [], "length": ["duration_s"]}


def equality_class(items: DataFrame, kind: str) -> DataFrame:
    """Adds class_seq, the first row of each row's equality class in its group, and class_size."""
    w = Window.partitionBy("group_id", *EQUALITY[kind])
    return items.withColumns({"class_seq": F.min("seq").over(w), "class_size": F.count("*").over(w)})


def selection(items: DataFrame, command: str) -> DataFrame:
    """checked_after for the commands identical, identical-but-size, oldest, newest, lowest-quality.

    A command acts on one cluster of a group, that of its first row; rows outside it keep their mark."""
    kind = "full" if command == "identical" else "but_size"
    df = equality_class(items, kind).withColumn("_first", F.min("seq").over(group()))
    inside = (F.col("class_seq") == F.col("_first")) & (F.col("class_size") > 1)
    if command == "lowest-quality":
        chosen = keepers(df.where(inside).select(*items.columns), list(criteria().values())).select("group_id", "seq", "is_keeper")
        df = df.join(chosen, ["group_id", "seq"], "left")
        return df.withColumn("checked_after", F.when(F.col("is_keeper").isNotNull(), ~F.col("is_keeper")).otherwise(F.col("checked"))).drop("class_seq", "class_size", "_first", "is_keeper")
    order = {"identical": F.asc("seq"), "identical-but-size": F.asc("size"), "oldest": F.desc("date_created"), "newest": F.asc("date_created")}[command]
    w = Window.partitionBy("group_id", "class_seq").orderBy(order, "seq")
    return df.withColumn("_nth", F.row_number().over(w)).withColumn("checked_after", F.when(inside, F.col("_nth") > 1).otherwise(F.col("checked"))).drop("class_seq", "class_size", "_first", "_nth")


def custom_selection(items: DataFrame, criteria_: Column, identity: str = "group", keep_newest: bool | None = None, skip_checked_groups: bool = True) -> DataFrame:
    """checked_after of the custom planner: rows that meet the criteria are marked; a class whose rows all do keeps one (by date, or
    the first), except that without a date rule a class of which only some do is marked as it is."""
    df = equality_class(items, identity)
    cls = Window.partitionBy("group_id", "class_seq")
    df = df.withColumns({"_hit": criteria_, "_busy": F.max("checked").over(group()) if skip_checked_groups else F.lit(False)})
    df = df.withColumns({"_hits": F.count_if(F.col("_hit")).over(cls)})
    order = F.asc("seq") if keep_newest is None else F.desc("date_created") if keep_newest else F.asc("date_created")
    df = df.withColumn("_nth", F.row_number().over(cls.orderBy(F.desc(F.col("_hit").cast("int")), order, "seq")))
    whole = F.col("_hits") == F.col("class_size")
    keep_one = whole if keep_newest is None else F.lit(True)
    marked = F.col("_hit") & ~F.col("_busy") & (F.col("class_size") > 1) & ~(keep_one & (F.col("_nth") == 1))
    return df.withColumn("checked_after", F.when(marked, F.lit(True)).otherwise(F.col("checked"))).drop("class_seq", "class_size", "_hit", "_busy", "_hits", "_nth")


def expression_groups(items: DataFrame, predicate: Column) -> DataFrame:
    """group_id, hits, members, and whether a predicate hits a group wholly, partly or not at all."""
    each = items.groupBy("group_id").agg(F.count_if(predicate).alias("hits"), F.count("*").alias("members"))
    return each.withColumn("match", F.when(F.col("hits") == 0, "none").when(F.col("hits") == F.col("members"), "whole").otherwise("part"))


def deltas(items: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Adds <column>_delta, the percent by which each value differs from its group's best (0 at the best); columns: name -> less is better."""
    out = {}
    for c, least in columns.items():
        best = (F.min if least else F.max)(c).over(group())
        out[f"{c}_delta"] = F.when(best != 0, (F.col(c) - best) / best.cast("double") * 100)
    return items.withColumns(out)


def hdr_upgrades(items: DataFrame) -> DataFrame:
    return items.withColumn("is_hdr_upgrade", F.col("hdr_rank") > F.min("hdr_rank").over(group()))


def chips(items: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Each row against the one before it in its group: better, worse or neutral by column."""
    w = group().orderBy("seq")
    out = {}
    for c, least in columns.items():
        before = F.lag(c).over(w)
        better = F.col(c) < before if least else F.col(c) > before
        out[f"{c}_chip"] = F.when(before.isNull() | (F.col(c) == before), "neutral").when(better, "better").otherwise("worse")
    return items.withColumns(out)


def culled(items: DataFrame) -> DataFrame:
    """The pairwise walk over a group in order of seq: from the second row on each meets the row that stands, and its ``decision`` keeps
    the left (standing) or the right (new) one; null passes on without a mark.

    Adds left_seq (the row that it meets, null for the first) and checked_after: a loser is checked, a row that won last is not, others
    stay.  Whoever stands is the last row that won, so no group is gathered."""
    order = group().orderBy("seq")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    df = items.withColumn("_nth", F.row_number().over(order)).withColumn("_d", F.when(F.col("_nth") > 1, F.col("decision")))
    won = F.coalesce(F.col("_d") == "right", F.lit(False))
    stands = won | (F.col("_nth") == 1)
    df = df.withColumn("left_seq", F.last(F.when(stands, F.col("seq")), ignorenulls=True).over(before))
    df = df.withColumn("_beaten", F.coalesce(F.max(won).over(after), F.lit(False)))
    # only the decisions until the next winner concern the row that stands; after that it is beaten anyway
    df = df.withColumn("_kept", F.coalesce(F.max(F.col("_d") == "left").over(after), F.lit(False)))
    lost = F.coalesce(F.col("_d") == "left", F.lit(False)) | (stands & F.col("_beaten"))
    out = F.when(lost, True).when(won | (stands & F.col("_kept")), False).otherwise(F.col("checked"))
    return df.withColumn("checked_after", out).drop("_nth", "_d", "_beaten", "_kept")


def toggles(items: DataFrame, visible: Column, action: str) -> DataFrame:
    """Bulk marks on visible rows: missing, clear or invert."""
    new = {"missing": F.col("checked") | ~F.col("file_exists"), "clear": F.lit(False), "invert": ~F.col("checked")}[action]
    return items.withColumn("checked_after", F.when(visible, new).otherwise(F.col("checked")))
