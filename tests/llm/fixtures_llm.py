from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, words string, key string, label string"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "src1", len(t or ""), 7, "w", "k", "l") for d, t in rows], SCHEMA)
