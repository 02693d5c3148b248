"""Schemas of the engine's tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STREAM = "struct<index:string,codec_name:string,codec_long_name:string,codec_type:string,pixel_format:string,width:int,height:int,sample_rate:int,channel_layout:string,bit_rate:bigint,frame_rate:float,channels:int,hdr_format:string>"
FRAME = "struct<pos_idx:int,t_sec:double,gray:binary,phash:bigint>"


_SIMPLE = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def _parts(text: str) -> list[str]:
    """The text cut at the commas outside of brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, _type(t)) for n, t in (p.split(":", 1) for p in _parts(text[7:-1]))])
    if text.startswith("decimal("):
        return T.DecimalType(*map(int, text[8:-1].split(",")))
    return _SIMPLE[text]


def _schema(ddl: str) -> T.StructType:
    """Without a session, which Spark's own parser needs."""
    return T.StructType([T.StructField(n, _type(t)) for n, t in (p.split(" ", 1) for p in _parts(ddl))])


MEDIA_ENTRY = _schema(f"path string, folder string, is_image boolean, flags int, date_created timestamp, date_modified timestamp, size bigint, duration_s double, streams array<{STREAM}>, frames array<{FRAME}>, audio_fp array<bigint>, os_hash string, file_exists boolean, root_ready boolean, st_dev bigint, st_ino bigint")
DUPLICATE_ITEM = _schema("group_id string, path string, folder string, size bigint, similarity double, duration_s double, frame_size string, frame_size_int int, format string, fps double, bitrate_kbs decimal(20,0), audio_format string, audio_channel string, sample_rate int, audio_bitrate_kbs decimal(20,0), hdr_format string, hdr_rank int, date_created timestamp, is_image boolean, flags int, partial_clip_offset_s double, checked boolean, seq bigint")
DENSE_FRAME = _schema("path string, k int, t_sec double, emb array<int>, sign bigint")
BLACKLIST = _schema("bl_id bigint, paths array<string>")
LOG_ENTRY = _schema("seq bigint, ts timestamp, severity string, message string, is_session_start boolean")
LISTING = _schema("path string, size bigint, date_created timestamp, date_modified timestamp, os_hash string")
RESULT_FILE = _schema("version int, items array<struct<groupId:string,path:string,sizeLong:bigint,similarity:double,isImage:boolean,flags:int>>")
CATALOG_VERSION = 3
