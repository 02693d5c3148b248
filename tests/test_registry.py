"""Every query with SQL gives what DuckDB gives on the same tables; the others run with a stable schema."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from twinlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    got, want = normal(registry.QUERIES[name](spark, sf).toPandas()), normal(duck.sql(registry.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_queries_without_sql_are_few():
    """Each of these is held against a plain model in test_operators.py or test_engine.py."""
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) <= {"s19_synthetic", "a01_greedy_groups", "a02_daisy_split"}


def test_text_functions_take_all_items(spark, sf):
    got = registry.QUERIES["sc_text_functions"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert 0 < got.where("moved LIKE '/new/%'").count() < got.where("moved LIKE '/lib%'").count()


def test_driver_contract(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_band_join_is_a_nested_loop(spark, sf):
    for name in ("j04_duration_band", "j09_partial_ratio", "p05_hash_pairs", "p13_int8_cosine_pairs"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = registry.QUERIES["f18_criteria"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[-1]
