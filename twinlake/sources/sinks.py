"""Sinks: catalog versions, JSON and CSV results, the scrubbed diagnostic export, blacklists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import numbering


def write_catalog(entries: DataFrame, path: str, version: int) -> None:
    """A whole new version beside the old ones; readers take it once Spark has committed it."""
    entries.write.mode("overwrite").parquet(f"{path}/v={version}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def diagnostic(entries: DataFrame) -> DataFrame:
    """Entries without their paths: a running id by path, facts, flags, and frames in order of position as base64."""
    frames = F.transform(F.array_sort(F.transform("frames", lambda f: F.struct(f["pos_idx"].alias("pos"), f["gray"].alias("gray")))), lambda f: F.base64(f["gray"]))
    needed = entries.select("path", "is_image", "flags", "size", "duration_s", "frames")  # what is numbered is written
    return numbering.numbered(needed, [F.col("path")], "id").select("id", "is_image", "flags", "size", "duration_s", frames.alias("frames"), F.transform("frames", lambda f: f["phash"]).alias("hashes"))


def result_groups(items: DataFrame) -> DataFrame:
    """One row for each group with its items, the most similar first."""
    item = F.struct((-F.col("similarity")).alias("order"), "seq", F.struct("path", "size", "similarity", "duration_s", "frame_size_int", "is_image").alias("item"))
    return items.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("items"))


def result_rows(items: DataFrame) -> DataFrame:
    """Rows for CSV in their order, all as text with a point and ISO dates."""
    ordered = items.orderBy("group_id", F.desc("similarity"), "seq")
    return ordered.select(F.col("group_id").cast("string").alias("group_id"), "path", F.col("size").cast("string").alias("size"), F.format_string("%.2f", F.col("similarity")).alias("similarity"), text.clock_text(F.col("duration_s")).alias("duration"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("frame_size"), F.format_string("%.2f", F.col("fps")).alias("fps"), F.col("bitrate_kbs").cast("string").alias("bitrate_kbs"), F.date_format("date_created", "yyyy-MM-dd HH:mm:ss").alias("date_created"), F.col("checked").cast("string").alias("checked"))


def export_rows(items: DataFrame, marks: bool = True) -> DataFrame:
    """Rows of the exported list, as text, a group's on adjacent rows in their order: 13 columns, or 12 without the marks."""
    flag = lambda c: F.initcap(F.col(c).cast("string"))
    columns = {
        "GroupId": F.col("group_id").cast("string"),
        "Path": F.col("path"),
        "SizeBytes": F.col("size").cast("string"),
        "Duration": text.invariant_span_text(F.col("duration_s")),
        "Resolution": F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")),
        "Fps": text.number_text(F.col("fps")),
        "BitrateKbs": text.number_text(F.col("bitrate_kbs")),
        "AudioFormat": F.col("audio_format"),
        "AudioSampleRate": F.col("sample_rate").cast("string"),
        "Similarity": text.number_text(F.col("similarity")),
        "DateCreated": F.date_format("date_created", "yyyy-MM-dd HH:mm:ss"),
        "IsImage": flag("is_image"),
    } | ({"Checked": flag("checked")} if marks else {})
    return items.orderBy("group_id", "seq").select(*(F.coalesce(c, F.lit("")).alias(n) for n, c in columns.items()))


def write_export(items: DataFrame, path: str, marks: bool = True) -> None:
    """``export_rows`` as CSV whose files begin with a byte order mark."""
    rows = export_rows(items, marks)
    rows.withColumnRenamed("GroupId", "\ufeffGroupId").write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_envelope(items: DataFrame, path: str, one_file: bool = False) -> None:
    """Results as a backup that ``readers.read_results`` takes: each file is {"version": 1, "items": [...]} by itself, with the rows of
    whole groups; ``one_file`` writes a single one, for a list that one task can hold open.  No rows give no items."""
    item = F.struct(F.col("group_id").cast("string").alias("groupId"), "path", F.col("size").alias("sizeLong"), "similarity", F.col("is_image").alias("isImage"), "flags")
    rows = items.coalesce(1) if one_file else items.repartitionByRange(F.col("group_id"))
    rows = rows.sortWithinPartitions("group_id", F.desc("similarity"), "path").select(F.to_json(item).alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = '{"version":1,"items":['
        for pdf in batches:
            if len(pdf):
                lines = pdf.value.radd(",")
                lines.iloc[0] = head + pdf.value.iloc[0]
                head = ","
                yield pd.DataFrame({"value": lines})
        if head == ",":
            yield pd.DataFrame({"value": ["]}"]})

    rows.mapInPandas(run, "value string").write.mode("overwrite").text(path)


def write_csv(items: DataFrame, path: str) -> None:
    result_rows(items).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_blacklist(blacklist: DataFrame, path: str) -> None:
    """{"version": 1, "groups": [[path, ...], ...]}, as a user's list: it is small."""
    blacklist.agg(F.lit(1).alias("version"), F.collect_list("paths").alias("groups")).coalesce(1).write.mode("overwrite").json(path)
