"""Registered queries against their oracles on the smallest tables, and the shape of their plans."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import duckdb
import pytest

from registry import load_catalogue

ROOT = Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("compare", ROOT / "tools" / "compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)

CATALOGUE = load_catalogue()
SLOW = {"classifier_evaluation", "unseen_scores"}  # covered by their own tests


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for table in compare.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in CATALOGUE if n not in SLOW])
def test_query(spark, duck, small_dir, name):
    query, sql = CATALOGUE[name]
    df = query(spark, small_dir)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python
    rows = compare._rows(df.columns, df.collect())
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows == compare._rows(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "risk_score" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_events_meet_their_small_facts_without_a_shuffle(spark, small_dir, monkeypatch):
    """the facts of the scored table are stored, so the planner knows that they fit a broadcast."""
    from registry import base

    plans, attach = [], base.X.attach

    def watched(rows, facts):
        plans.append(attach(rows, facts)._jdf.queryExecution().sparkPlan().toString())
        return attach(rows, facts)

    monkeypatch.setattr(base.X, "attach", watched)
    base._build_scored(spark, small_dir)
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]


def test_sorted_events_carry_only_what_is_shown(spark, small_dir, monkeypatch):
    """the events are put in order without their messages."""
    from emberlog.operators import explore

    widths, store = [], explore.store
    monkeypatch.setattr(explore, "store", lambda df: (widths.append(set(df.columns)), store(df))[1])
    CATALOGUE["newest_events"][0](spark, small_dir).count()
    assert widths and widths[0] <= {"event_id", "risk_score", "timestamp", "row_idx", "_mid"}


def test_every_service_has_a_place(spark):
    """all services are placed by frequency, past the twelve of the former cut; equal counts in text order."""
    from emberlog.operators.evaluate import service_places

    counts = [(f"s{k:02d}", 50 - k // 2) for k in range(40)]
    found = service_places(spark.createDataFrame(counts[::-1], "service string, n long")).collect()
    assert {r["service"]: r["service_index"] for r in found} == {s: k for k, (s, _) in enumerate(counts)}
