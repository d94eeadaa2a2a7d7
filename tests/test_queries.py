"""Every registered query with SQL gives DuckDB's rows at the smallest scale."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from provisio.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SKIP = {"for_fold_training", "for_tuned_parameters", "for_history_weight_models", "for_boosted_trees", "for_tweedie", "lt_long_lead_classifier", "for_hyper_grid", "for_batch_scoring"}  # trained models: tests of their own


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return f"{float(v):.5g}"
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v))[:19]
    return f"{v} 00:00:00" if isinstance(v, datetime.date) else str(v)


def rows(df: pd.DataFrame) -> list:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql_or_is_a_model():
    assert {n for n in QUERIES if n not in SQL} <= SKIP


def test_entry_imports_without_llm(monkeypatch):
    import builtins
    import importlib
    import sys

    import __spark_entry__

    real = builtins.__import__

    def without(name, *a, **k):
        if name.startswith(("provisio.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith(("provisio.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.reload(__spark_entry__)
    assert "led_monthly_fact" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
