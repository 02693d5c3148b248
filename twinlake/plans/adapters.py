"""The engine's tables, made from the driver's: expressions that mean the same to Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: duplicate items: an order is a group, its lines are the items.
ITEMS = {
    "group_id": "l_orderkey",
    "seq": "((l_partkey * 100000 + l_suppkey) * 8 + l_linenumber) * 64 + CAST(floor(l_quantity) AS BIGINT)",
    "path": "concat('/lib', l_suppkey % 7, '/o', l_orderkey, '/p', l_partkey, '_', l_suppkey, '.mp4')",
    "folder": "concat('/lib', l_suppkey % 7, '/o', l_orderkey)",
    "size": "CAST(floor(l_extendedprice * 100) AS BIGINT)",
    "similarity": "CAST(100 - (CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey % 9 END) AS DOUBLE)",
    "duration_s": "CAST(CAST(floor(l_quantity) AS BIGINT) * 13 % 600 AS DOUBLE)",
    "width": "CAST(640 + 320 * (l_partkey % 6) AS INT)",
    "height": "CAST(360 + 180 * (l_suppkey % 5) AS INT)",
    "frame_size_int": "CAST(1000 + 320 * (l_partkey % 6) + 180 * (l_suppkey % 5) AS INT)",
    "fps": "CAST(24 + l_linenumber % 7 AS DOUBLE)",
    "bitrate_kbs": "500 + (l_partkey * 37 + l_suppkey * 11) % 4000",
    "audio_bitrate_kbs": "64 + 32 * (l_suppkey % 5)",
    "sample_rate": "CASE WHEN l_partkey % 2 = 0 THEN 44100 ELSE 48000 END",
    "is_image": "l_returnflag = 'A'",
    "flags": "CAST(l_linenumber * 5 % 32 AS INT)",
    "checked": "l_partkey % 4 = 0",
    "file_exists": "l_partkey % 11 <> 0",
    "root_ready": "l_suppkey % 5 <> 0",
    "hdr_rank": "CAST(l_partkey % 5 AS INT)",
    "date_created": "l_shipdate",
    "st_dev": "l_suppkey % 2",
    "st_ino": "l_partkey % 50",
}
#: catalog entries: a customer is a file.
ENTRIES = {
    "path": "concat('/m', c_nationkey % 5, '/n', c_nationkey, '/', c_name, CASE WHEN c_custkey % 3 = 0 THEN '.jpg' ELSE '.mp4' END)",
    "folder": "concat('/m', c_nationkey % 5, '/n', c_nationkey)",
    "idx": "c_custkey",
    "is_image": "c_custkey % 3 = 0",
    "flags": "CAST(c_custkey * 7 % 1024 AS INT)",
    "size": "CAST(floor(abs(c_acctbal) * 100000) AS BIGINT)",
    "file_exists": "c_custkey % 9 <> 0",
    "root_ready": "c_nationkey % 6 <> 0",
    "segment": "c_mktsegment",
}
#: durations with keys: a document's length is its seconds.
TIMED = {"idx": "doc_id", "duration_s": "CAST(n_chars AS DOUBLE)", "lang": "lang", "source": "source"}


def adapted(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def sql(name: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {name}"


ITEMS_SQL = f"WITH items AS ({sql('lineitem', ITEMS)})"
ENTRIES_SQL = f"WITH entries AS ({sql('customer', ENTRIES)})"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, "lineitem", ITEMS)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, "customer", ENTRIES)


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, "documents", TIMED).where("duration_s > 0")
