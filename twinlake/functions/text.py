"""Scalar functions on paths, messages, sizes, times and probe results, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def glob_regex(pattern: str, whole: bool = True) -> str:
    """``*`` and ``?`` as a case-insensitive regular expression (whole: anchored at both ends)."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?is)^{body}$" if whole else f"(?is){body}"


def matches_any(path: Column, patterns: list[str], whole: bool = True) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p, whole))
    return out


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def last_segments(path: Column, n: int) -> Column:
    """The last n segments of a folder, lower case."""
    return F.lower(F.substring_index(path, "/", -n))


def under(path: Column, root: str, recursive: bool = True) -> Column:
    """A folder is the root or, if recursive, stands below it on a segment boundary."""
    same = path == root
    return same | path.startswith(root.rstrip("/") + "/") if recursive else same


def moved(path: Column, old: str, new: str) -> Column:
    """A path's prefix replaced, on a segment boundary."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when((path == old) | path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def size_text(size: Column) -> Column:
    """1536 -> "1.5 KB"."""
    out = F.format_string("%.1f B", size.cast("double"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1):
        out = F.when(size >= 1 << (10 * i), F.format_string(f"%.1f {unit}", size / F.lit(float(1 << (10 * i))))).otherwise(out)
    return F.when(size == 0, "0 B").otherwise(out)


def megabytes(size: Column) -> Column:
    return F.floor(size / 1048576).cast("long")


def span_text(seconds: Column) -> Column:
    """93784 -> "1d, 2h": the two largest units; the second only if it isn't zero, but seconds always."""
    s = F.floor(seconds).cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda a, u, b, v: F.when(b > 0, F.format_string(f"%d{u}, %d{v}", a, b)).otherwise(F.format_string(f"%d{u}", a))
    return F.when(d > 0, two(d, "d", h, "h")).when(h > 0, two(h, "h", m, "m")).when(m > 0, F.format_string("%dm, %ds", m, r)).otherwise(F.format_string("%ds", r))


def clock_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def message_key(message: Column) -> Column:
    """Messages that differ in numbers or quoted parts only have one key."""
    quoted = F.regexp_replace(F.regexp_replace(message, "\"[^\"]*\"", "\"*\""), "'[^']*'", "'*'")
    return F.regexp_replace(quoted, "[0-9]+", "#")


def shortened(text: Column, most: int) -> Column:
    """A long text without its middle."""
    left = (most - 1 + 1) // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(left)), F.lit("…"), F.right(text, F.lit(most - 1 - left)))).otherwise(text)


#: Fixed values.  Marks in an error text, the first group that has one names the cause.
ERRORS = [
    ("HardwareAcceleration", ["lacking required capabilities", "hwaccel initiali", "failed setup for format", "no device available for decoder", "hwaccel transfer data failed", "cannot load nvcuda", "cannot load libcuda", "cannot load cuda", "hw_device_ctx", "device creation failed"]),
    ("LibraryLoad", ["unable to load shared library", "could not load", "dllnotfound", "the installed ffmpeg major version does not match", "version mismatch"]),
    ("UnsupportedCodec", ["decoder not found", "unknown decoder", "no decoder for", "codec not currently supported"]),
    ("CorruptOrTruncated", ["moov atom not found", "invalid data found when processing input", "invalid nal unit size", "error splitting the input into nal units", "could not find codec parameters", "non-existing pps", "non-existing sps", "error while decoding", "partial file", "truncat"]),
    ("FileAccess", ["permission denied", "no such file or directory", "operation not permitted", "protocol not found"]),
    ("HardwareAcceleration", ["generic error in an external library"]),
]


def error_cause(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("Unknown")
    for cause, marks in reversed(ERRORS):
        found = F.lit(False)
        for m in marks:
            found = found | low.contains(m)
        out = F.when(found, cause).otherwise(out)
    return F.coalesce(out, F.lit("Unknown"))


#: Fixed values.  What a probe tells of a stream and its container.
PROBE = T.StructType(
    [
        T.StructField("streams", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("index", "codec_name", "codec_long_name", "codec_type", "pix_fmt", "width", "height", "sample_rate", "channels", "channel_layout", "bit_rate", "r_frame_rate", "color_transfer")] + [T.StructField("side_data_list", T.ArrayType(T.StructType([T.StructField("side_data_type", T.StringType())])))]))),
        T.StructField("format", T.StructType([T.StructField("duration", T.StringType()), T.StructField("bit_rate", T.StringType())])),
    ]
)


def probed(json: Column) -> Column:
    return F.from_json(json, PROBE)


def frame_rate(text: Column) -> Column:
    """"num/den" -> frames a second, -1 if it can't be read."""
    num, den = F.substring_index(text, "/", 1).try_cast("double"), F.substring_index(text, "/", -1).try_cast("double")
    return F.coalesce(F.when(text.contains("/") & (den != 0), num / den), F.lit(-1.0))


def duration_seconds(text: Column) -> Column:
    """Seconds, or hours:minutes:seconds; whole seconds, cut off."""
    part = F.split(text, ":")
    clock = F.when(F.size(part) == 3, part[0].try_cast("double") * 3600 + part[1].try_cast("double") * 60 + F.get(part, F.lit(2)).try_cast("double"))
    return F.floor(F.coalesce(text.try_cast("double"), clock)).cast("long")


def hdr_format(transfer: Column, side_data: Column) -> Column:
    t, s = F.lower(F.coalesce(transfer, F.lit(""))), F.lower(F.coalesce(side_data, F.lit("")))
    pq = F.when(s.contains("dovi"), "Dolby Vision").when(s.contains("smpte2094"), "HDR10+").otherwise("HDR10")
    return F.when(t == "arib-std-b67", "HLG").when(t == "smpte2084", pq).otherwise("")


#: Fixed values.
HDR_RANKS = {"HLG": 1, "HDR10": 2, "HDR10+": 3, "Dolby Vision": 4}


def hdr_rank(name: Column) -> Column:
    out = F.lit(0)
    for k, v in HDR_RANKS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def cache_key(name: Column) -> Column:
    """16 hex digits by which a cache names a path: a 64-bit hash of its UTF-16 bytes (Spark's seed, so no other program's keys);
    null for null."""
    return F.when(name.isNotNull(), F.lpad(F.lower(F.hex(F.xxhash64(F.encode(name, "UTF-16LE")))), 16, "0"))


def similarity_band(percent: Column) -> Column:
    return F.when(percent >= 99, "high").when(percent >= 90, "mid").otherwise("low")


def kilobits(bits: Column) -> Column:
    """Bits a second -> whole kilobits, halves to even."""
    return F.bround(bits.cast("decimal(20,0)") / 1000, 0).cast("decimal(20,0)")


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.0), elapsed * (total - done) / (done + 1))


def near_in_time(a: Column, b: Column, seconds: float) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) <= int(seconds * 1_000_000)


def invariant_span_text(seconds: Column) -> Column:
    """[d.]hh:mm:ss[.fffffff], days and parts of a second only where there are any."""
    ticks = F.round(F.abs(seconds) * 10_000_000).cast("long")
    whole, part = F.floor(ticks / 10_000_000).cast("long"), ticks % 10_000_000
    days = F.floor(whole / 86_400).cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(whole % 86_400 / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60)
    before = F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise("")
    after = F.when(part > 0, F.format_string(".%07d", part)).otherwise("")
    return F.concat(F.when((seconds < 0) & (ticks > 0), "-").otherwise(""), before, clock, after)


def number_text(number: Column) -> Column:
    """A number without a fraction of 0."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")
