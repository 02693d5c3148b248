"""Sources: file listings, catalogs, results, blacklists, caches, a synthetic corpus, and frames or audio from pluggable decoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import schema

#: Fixed values.  File name endings of media.
VIDEO = "mp4 wmv avi mkv flv mov mpg mpeg m4v asf f4v webm divx m2t m2ts vob ts 3gp ogv mts rm rmvb qt".split()
IMAGE = "jpg jpeg png gif bmp tiff webp heic heif avif jxl".split()


def list_files(spark: SparkSession, folder: str, images: bool = True, recursive: bool = True, exclude: list[str] | None = None) -> DataFrame:
    """path, size, date_modified, is_image of media files: the contents are never read, as only metadata columns are kept."""
    endings = "|".join([*VIDEO, *(IMAGE if images else [])])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    df = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("date_modified")).where(F.col("path").rlike(rf"(?i)\.({endings})$"))
    df = df.withColumn("is_image", F.col("path").rlike(rf"(?i)\.({'|'.join(IMAGE)})$"))
    return df.where(~text.matches_any(text.folder(F.col("path")), exclude)) if exclude else df


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest whole version, or the one asked for: a version counts once its commit marker is written.

    A damaged file ends the read with an error, as rows that are left out in silence would be taken for deleted files; the version
    before it can then be asked for.  A path without versions, or a version that isn't there, gives no rows."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marker) or []
    there = {int(f.getPath().getParent().getName().removeprefix("v=")) for f in found}
    wanted = max(there, default=None) if version is None else version
    if wanted not in there:
        return spark.createDataFrame([], schema.MEDIA_ENTRY)
    return spark.read.schema(schema.MEDIA_ENTRY).option("ignoreCorruptFiles", "false").parquet(f"{path}/v={wanted}")


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    wrapped = T.StructType([T.StructField("Version", T.IntegerType()), T.StructField("Entries", T.ArrayType(schema.MEDIA_ENTRY))])
    return spark.read.schema(wrapped).json(path, multiLine=True).selectExpr("inline(Entries)")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of either shape: an array of items, or an envelope {version, items}."""
    item = schema.RESULT_FILE["items"].dataType.elementType
    both = T.StructType([*item.fields, *schema.RESULT_FILE.fields])
    df = spark.read.schema(both).json(path, multiLine=True)
    own = F.struct(*(F.col(f.name) for f in item.fields))
    return df.select(F.explode(F.coalesce("items", F.array(own))).alias("i")).select("i.*").where("path IS NOT NULL")


def read_result_groups(spark: SparkSession, path: str) -> DataFrame:
    """An array of groups, each with its items."""
    group = T.StructType([T.StructField("groupId", T.StringType()), T.StructField("items", schema.RESULT_FILE["items"].dataType)])
    return spark.read.schema(group).json(path, multiLine=True).select(F.explode("items").alias("i")).select("i.*")


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Version 0 (an array of arrays) or 1 ({version, groups}); a file that is neither gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    sets = F.coalesce(F.from_json("value", T.ArrayType(T.ArrayType(T.StringType()))), F.from_json("value", "struct<version:int,groups:array<array<string>>>")["groups"])
    return raw.select(F.posexplode(sets).alias("bl_id", "paths")).select(F.col("bl_id").cast("long").alias("bl_id"), "paths").where("paths IS NOT NULL")


def synthetic(spark: SparkSession, n: int, seed: int = 42, group_every: int = 6) -> DataFrame:
    """A catalog of n entries; every ``group_every``-th starts a run of near copies.  Values come from hashes of the row's number, so
    any partitioning gives the same rows."""
    h = lambda salt: F.pmod(F.xxhash64("base", F.lit(seed), F.lit(salt)), F.lit(1_000_003)) / 1_000_003
    df = spark.range(n).withColumn("base", F.when(F.col("id") % group_every < 2, F.col("id") - F.col("id") % group_every).otherwise(F.col("id")))
    size = (5_000_000 + h("size") * 245_000_000).cast("long")
    return df.select(
        F.concat(F.lit("/media/"), (F.col("base") % 97).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".mp4")).alias("path"),
        F.concat(F.lit("/media/"), (F.col("base") % 97).cast("string")).alias("folder"),
        F.lit(False).alias("is_image"),
        F.lit(0).alias("flags"),
        size.alias("size"),
        (5 + h("duration") * 3595 + (F.col("id") - F.col("base")) * 0.01).alias("duration_s"),
        (640 + h("w") * 3200).cast("int").alias("width"),
        (360 + h("h") * 1800).cast("int").alias("height"),
        (24 + h("fps") * 36).alias("fps"),
        (1000 + h("rate") * 19000).cast("long").alias("bitrate_kbs"),
        F.col("base").alias("cluster"),
        F.col("id").alias("idx"),
    )


def probe(entries: DataFrame, tool: Callable[[str], str | None]) -> DataFrame:
    """Adds info, what a probe tool tells of each path as JSON, parsed in the JVM; a path that fails has null info."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            def one(path: str) -> str | None:
                try:
                    return tool(path)
                except Exception:  # a damaged file mustn't end the scan; its info stays null
                    return None

            yield pdf.assign(probe_json=[one(p) for p in pdf.path])

    out = T.StructType([*entries.schema.fields, T.StructField("probe_json", T.StringType())])
    return entries.mapInPandas(run, out).withColumn("info", text.probed(F.col("probe_json"))).drop("probe_json")


def frames_at(entries: DataFrame, decoder: Callable[[str, list[float]], list[bytes | None]]) -> DataFrame:
    """path, pos_idx, t_sec, gray at the times of each row's ``seconds`` (an array, any order); a frame that can't be read is null, a null
    or empty array gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, times in zip(pdf.path, pdf.seconds, strict=True):
                times = [] if times is None else [float(t) for t in times]
                try:
                    frames = decoder(path, times) if times else []
                except Exception:  # as for probes
                    frames = [None] * len(times)
                rows += [(path, i, t, f) for i, (t, f) in enumerate(zip(times, frames, strict=True))]
            yield pd.DataFrame(rows, columns=["path", "pos_idx", "t_sec", "gray"])

    return entries.select("path", "seconds").mapInPandas(run, "path string, pos_idx int, t_sec double, gray binary")


def sample_frames(entries: DataFrame, decoder: Callable[[str, list[float]], list[bytes | None]], positions: int = 1, longest: float = 0) -> DataFrame:
    """``frames_at`` evenly spread positions of each file, or of its first ``longest`` seconds; frames that can't be read are remembered
    as such."""
    span = F.least("duration_s", F.lit(float(longest))) if longest else F.col("duration_s")
    return frames_at(entries.select("path", F.array(*(span * ((i + 1) / (positions + 1)) for i in range(positions))).alias("seconds")), decoder)


def dense_frames(entries: DataFrame, decoder: Callable[[str, list[float]], list[bytes | None]], embed: Callable[[list[bytes]], list[list[float]]], batch: int = 16) -> DataFrame:
    """path, k, t_sec, vector: one frame an interval (400 at most), embedded ``batch`` at a time; memory holds one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, seconds in zip(pdf.path, pdf.duration_s, strict=True):
                step = max(min(max(seconds / 60, 5.0), 15.0), seconds / 400)
                times = [k * step for k in range(min(400, int(seconds / step) + 1))]
                for a in range(0, len(times), batch):
                    frames = decoder(path, times[a : a + batch])
                    vectors = iter(embed([f for f in frames if f is not None]))
                    yield pd.DataFrame([(path, a + i, times[a + i], list(next(vectors)) if f is not None else None) for i, f in enumerate(frames)], columns=["path", "k", "t_sec", "vector"])

    return entries.select("path", "duration_s").mapInPandas(run, "path string, k int, t_sec double, vector array<double>")
