"""Queries with SQL give what DuckDB gives on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from twinlake.llm import chat
from twinlake.llm.queries import ORACLE_SQL, QUERIES


def equal(got, want):
    order = sorted(got.columns)
    got, want = (x[order].astype(object).map(lambda v: "null" if pd.isna(v) else str(v).removesuffix(".0")).sort_values(order, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    equal(QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE_SQL[name]).df())


def test_quotes_match_sql(spark):
    """The tables have no quotes, so planted ones are compared as well."""
    rows = [(c, t, "user", text) for c in (1, 2, None) for t, text in enumerate(["One line.\n\nTwo  lines\nhere", "> one LINE.\nno", ">> One line.\n> no\n> no more\nyes", "Ann wrote:\n> two lines\n> here\n\n\n\nso\r\n", "> yes\n >> no\n>\n> so\nend", "", "> two\n> lines here\n> \n> one line.\nboth"])]
    df = spark.createDataFrame([*rows, (1, None, None, None), (1, 2, "user", "> no\nagain")], "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by name
    con.sql("CREATE TABLE conversations AS SELECT * FROM conversations")
    equal(chat.format_chat(df).toPandas(), con.sql(ORACLE_SQL["op10_chat_format"]).df())
