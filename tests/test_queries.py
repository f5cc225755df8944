"""Registered queries on the driver's smallest tables, against their SQL in DuckDB."""

import collections

import duckdb
import pytest

import __spark_entry__
from terrasift.queries import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def normal(value):
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, data, name):
    frame = QUERIES[name](spark, data)
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
        cursor = db.execute(ORACLES[name])
        columns, rows = [c[0] for c in cursor.description], cursor.fetchall()
    assert sorted(columns) == sorted(frame.columns)
    order = [columns.index(c) for c in frame.columns]
    got, want = (collections.Counter(repr(tuple(map(normal, r))) for r in x) for x in (frame.collect(), ([r[i] for i in order] for r in rows)))
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert [r.rank for r in rows] == list(range(1, 21))
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_joins_of_equal_keys_need_no_nested_loop(spark, data):
    """Range lookups are equi joins on squares; nothing compares every pair."""
    for name in ("tolerance_lookup", "nearest_grid", "exact_lookup"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_what_they_need(spark, data):
    plan = QUERIES["lcoa_describe"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "o_totalprice" in plan


def test_tolerance_overrides(spark, data):
    """Brute force over all pairs, in its own SQL without the strings that DuckDB stumbles over."""
    from terrasift.fixtures import load

    cells = load(spark, data, "cells").collect()
    where = {c.cell_id: (c.latitude, c.longitude) for c in cells}
    rows = sorted((r.file_order, where[r.cell_id][0] + r.file_order % 7 * 0.05, where[r.cell_id][1], r.tech, r.interest_rate, r.build_cost_multiplier) for r in load(spark, data, "spatial").collect())
    want = {}
    for c in cells:
        for _, lat, lon, tech, rate, factor in rows:
            if abs(lat - c.latitude) <= 0.125 and abs(lon - c.longitude) <= 0.125:
                last = want.setdefault((c.cell_id, tech), [None, None])
                want[c.cell_id, tech] = [rate if rate is not None else last[0], factor if factor is not None else last[1]]
    rounded = lambda x: x if x is None else round(x, 6)
    got = {(r.id, r.tech): [r.interest_rate, r.build_cost_multiplier] for r in QUERIES["tolerance_overrides"](spark, data).collect()}
    assert got == {k: [rounded(x) for x in v] for k, v in want.items()}
