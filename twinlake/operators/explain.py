"""Why two entries match or don't: every gate of the comparison as a row of an array, from the same expressions that decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scope, verdict


def explain(pairs: DataFrame, m: verdict.Matching, percent: float = 20, least: float = 0, most: float = 0, folders: str = "none", depth: int = 1) -> DataFrame:
    """Adds gates (array of struct gate, pass, measured, required), verdict and hint to pairs (columns with _a and _b)."""
    from ..functions import kernels

    a, b = F.col("duration_s_a"), F.col("duration_s_b")
    allowed = F.least(kernels.duration_tolerance(a, percent, least, most), kernels.duration_tolerance(b, percent, least, most))
    df = verdict.judged(pairs, m)
    row = lambda gate, ok, measured, required: F.struct(F.lit(gate).alias("gate"), F.coalesce(ok, F.lit(False)).alias("pass"), measured.cast("string").alias("measured"), required.cast("string").alias("required"))
    kinds: Column = F.col("is_image_a") == F.col("is_image_b")
    gates = [
        row("kind", kinds, F.concat_ws("/", F.col("is_image_a").cast("string"), F.col("is_image_b").cast("string")), F.lit("equal")),
        row("errors", ~kernels.has_any(F.col("entry_flags_a").bitwiseOR(F.col("entry_flags_b")), scope.ALL_ERRORS), F.col("entry_flags_a").bitwiseOR(F.col("entry_flags_b")), F.lit("none")),
        row("duration", F.col("is_image_a") | (F.abs(a - b) <= allowed), F.abs(a - b), allowed),
        row("folder", scope.folder_gate(F.col("folder_a"), F.col("folder_b"), folders, depth), F.concat_ws(" ", "folder_a", "folder_b"), F.lit(folders)),
        row("content", F.col("similar"), F.col("difference"), F.lit(m.limit)),
    ]
    df = df.withColumn("gates", F.array(*gates))
    failed = F.filter("gates", lambda g: ~g["pass"])
    hints = {"kind": "images never match videos", "errors": "an entry has errors; clear its flags and scan again", "duration": "raise the duration tolerance", "folder": "change the folder rule", "content": "lower the similarity percentage"}
    hint = F.lit(None).cast("string")
    first = F.get(failed, F.lit(0))["gate"]
    for gate, say in hints.items():
        hint = F.when(first == gate, say).otherwise(hint)
    return df.withColumns({"verdict": F.when(F.size(failed) == 0, "match").otherwise("no match"), "hint": hint})


def expression(df: DataFrame, sql: str, allowed: tuple[str, ...] | None = None) -> Column:
    """A user's predicate over the rows' columns.  It must be a deterministic boolean of known columns, and no subquery or aggregate."""
    low = sql.lower()
    if any(word in low.replace("(", " ").split() for word in ("select", "exists", "rand", "randn", "uuid", "java_method", "reflect", "input_file_name", "current_timestamp", "now")):
        raise ValueError("only plain expressions of columns are allowed")
    named = df.select(*allowed) if allowed else df
    checked = named.where(F.expr(sql))  # unknown columns, aggregates and other types fail here, before any row is read
    if dict(named.selectExpr(f"({sql}) AS x").dtypes)["x"] != "boolean":
        raise ValueError("the expression must be true or false")
    del checked
    return F.expr(sql)
