"""What holds when one key has most of the rows, or files are many: same rows as by force, and plans that say how."""

import collections
import datetime
import json
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrasift.fixtures import load
from terrasift.operators import analysis, lookup, results, weather
from terrasift.queries import QUERIES
from terrasift.sources import sinks, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_axes_of_many_lines(spark):
    """More lines than pieces, values between, on and beyond them."""
    r = random.Random(2)
    lines = sorted({round(r.uniform(-90, 90) ** 3, 3) for _ in range(5000)})
    place = {x: k for k, x in enumerate(r.sample(lines, len(lines)))}
    values = [*r.sample(lines, 300), *(r.uniform(-1e6, 1e6) for _ in range(500)), *((a + b) / 2 for a, b in zip(lines[:300], lines[1:301])), -1e9, 1e9]
    axis = spark.createDataFrame([(x, place[x]) for x in lines], "axis_value double, position int").repartition(3)
    asked = spark.createDataFrame([(v,) for v in values], "value double")
    for tie, key in {"least": lambda v: lambda a: (abs(a - v), a), "greatest": lambda v: lambda a: (abs(a - v), -a), "first": lambda v: lambda a: (abs(a - v), place[a])}.items():
        got = {x.value: x.nearest for x in lookup.nearest_on_axis(asked, axis, tie).collect()}
        assert got.keys() == set(values)
        for v in values:
            at = int(np.searchsorted(lines, v))
            assert got[v] == min(lines[max(0, at - 2) : at + 3], key=key(v)), (tie, v)
    assert lookup.axis_step(axis, "axis_value").first().step == min(b - a for a, b in zip(lines, lines[1:]))
    assert lookup.nearest_on_axis(asked, axis.limit(0)).count() == 0 and lookup.axis_step(axis.limit(0), "axis_value").first().step is None


def test_no_ordering_without_keys_and_no_nested_loop(spark, data):
    for name in ("nearest_grid", "cells_table", "snapped_latitudes", "axis_step", "weather_of_sites", "country_lcoa_stats", "country_box_stats"):
        text = plan(QUERIES[name](spark, data))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert not re.search(r"windowspecdefinition\(\S+ (?:ASC|DESC)", text), name


def task_rows(df):
    """Rows of each task of a last stage."""
    return sorted(df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect(), key=lambda r: r.p)


def test_a_square_with_half_of_all_rows_is_many_tasks(spark):
    r = random.Random(3)
    rows = [(50.01, 8.01, k) for k in range(3000)] + [(r.uniform(40, 60), r.uniform(0, 20), 3000 + k) for k in range(3000)]
    probes = [(k, 50.0 + r.uniform(-0.3, 0.3), 8.0 + r.uniform(-0.3, 0.3)) for k in range(30)] + [(k, r.uniform(40, 60), r.uniform(0, 20)) for k in range(30, 60)]
    places = spark.createDataFrame(rows, "latitude double, longitude double, file_order long")
    probe = spark.createDataFrame(probes, "id long, latitude double, longitude double")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = lookup.within_tolerance(probe, places, limit=20)
        got = collections.Counter((x.id, x.file_order) for x in found.collect())
        counts = [x["count"] for x in task_rows(found)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = collections.Counter((i, o) for i, a, b in probes for la, lo, o in rows if abs(la - a) <= 0.125 and abs(lo - b) <= 0.125)
    assert got == want and max(counts) < sum(counts) / 10
    many = spark.createDataFrame([(k, 50.0, 8.0) for k in range(500)], "id long, latitude double, longitude double")
    assert lookup.within_tolerance(many, places, limit=100).count() == 500 * sum(abs(la - 50.0) <= 0.125 and abs(lo - 8.0) <= 0.125 for la, lo, _ in rows)


def ring(n, x, y, radius, r):
    """Edges of a ragged ring."""
    points = [(x + radius * (1 + r.uniform(-0.2, 0.2)) * np.cos(a), y + radius * (1 + r.uniform(-0.2, 0.2)) * np.sin(a)) for a in np.linspace(0, 2 * np.pi, n, endpoint=False)]
    return [(float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(points, points[1:] + points[:1])]


def inside_by_force(x, y, edges):
    crossed = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1 if y2 != y1 else 1.0) + x1 for x1, y1, x2, y2 in edges)
    on = any((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for x1, y1, x2, y2 in edges)
    return crossed % 2 == 1 or on


def test_polygons_by_tiles(spark, monkeypatch):
    """Ragged rings with a hole, boxes on whole degrees, neighbours: same country as by force, and few edges tested."""
    monkeypatch.setattr(lookup, "BAND_EDGES", 16)
    r = random.Random(5)
    box = lambda a, b, c, d: [(a, b, a, d), (a, d, c, d), (c, d, c, b), (c, b, a, b)]
    polygons = [ring(400, 10.3, 20.2, 6.0, r) + ring(60, 10.0, 20.0, 2.0, r), box(20.0, 10.0, 30.0, 15.0) + box(22.0, 12.0, 24.0, 13.0), box(30.0, 10.0, 33.5, 14.25), ring(30, -0.2, -0.4, 0.3, r), box(15.0, 15.0, 16.0, 30.0)]
    edges = spark.createDataFrame([(f"c{k}", k, *e) for k, p in enumerate(polygons) for e in p], "country string, polygon_order int, x1 double, y1 double, x2 double, y2 double")
    points = [(r.uniform(-2, 36), r.uniform(-2, 32)) for _ in range(1500)] + [(float(x), float(y)) for x in range(19, 35) for y in range(9, 17)] + [(30.0, 12.5), (22.0, 12.0), (23.0, 12.5), (24.0, 12.2), (33.5, 11.0), (33.5, 14.25)] + [e[:2] for e in polygons[0][:50]]
    frame = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "id long, x double, y double")
    got = {x.id: x.country for x in lookup.locate_country(frame, edges).collect()}
    for k, (x, y) in enumerate(points):
        assert got[k] == next((f"c{n}" for n, p in enumerate(polygons) if inside_by_force(x, y, p)), None), (k, x, y)
    tested = collections.Counter(x.id for x in lookup.tested_edges(frame, edges, lookup.country_tiles(edges)).select("id").collect())
    every = sum(map(len, polygons)) * len(points)
    assert sum(tested.values()) < every / 20 and max(tested.values()) < 120
    tiles = lookup.country_tiles(edges).collect()
    crossed = {(x.tile_x, x.tile_y) for x in tiles if x.crossed}
    inner = {(x.tile_x, x.tile_y) for x in tiles if not x.crossed} - crossed
    of = [(int(np.floor(x)), int(np.floor(y))) for x, y in points]
    assert len(set(of) & inner) > 50 and all(not tested[k] for k, tile in enumerate(of) if tile not in crossed)


def test_quantiles_of_a_group_with_most_rows(spark):
    r = random.Random(6)
    rows = [("big", r.expovariate(1e-3) ** 2) for _ in range(5000)] + [("big", 7.0)] * 500 + [("one", 3.0), (None, 1.0), (None, 2.0), ("void", None), ("wild", 1e300), ("wild", -1e300), ("wild", 1e-300), ("wild", 2e-300), ("wild", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    found = {x.g: x for x in analysis.quantiles_of(df, "v", {"a": 0.0, "q": 0.25, "m": 0.5, "z": 0.99}, "g", pieces=8).collect()}
    of = lambda g: [v for k, v in rows if k == g and v is not None and v == v]
    assert found.keys() == {"big", "one", None, "wild"}
    for g in found:
        for name, q in (("a", 0.0), ("q", 0.25), ("m", 0.5), ("z", 0.99)):
            assert found[g][name] == pytest.approx(np.quantile(of(g), q), rel=1e-9), (g, name)
    described = {x.g: x for x in analysis.describe(df, "v", "g").collect()}
    assert described["void"]["count"] == 0 and described["void"].p50 is None and described[None].p50 == 1.5
    boxes = {x.g: x for x in analysis.box_stats(df, "g", "v").collect()}
    q1, q3 = np.quantile(of("big"), [0.25, 0.75])
    kept = [v for v in of("big") if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (boxes["big"].low, boxes["big"].high) == (min(kept), max(kept)) and boxes["one"].median == 3.0 and None not in boxes
    stats = {x.country: x for x in analysis.country_stats(df.select(F.col("g").alias("country"), F.col("v").alias("lcoa_per_t"))).collect()}
    assert stats["void"].sites == 0 and stats["void"].median_lcoa is None and stats["big"].sites == 5500
    assert stats["big"].median_lcoa == pytest.approx(statistics.median(of("big")))


def weather_rows(spark, resource_values):
    return spark.createDataFrame([(float(k), 0.0, r, "2024-01-01 00:00:00", 0.1 * k) for k, r in enumerate(resource_values)], "latitude double, longitude double, resource string, t string, cf double").select("*", F.to_timestamp("t").alias("ts")).drop("t")


def test_weather_sets(spark, tmp_path):
    rows = weather_rows(spark, ["wind", "solar", "wind", "solar_tracking"])
    for root, name in (("a", "weather2019"), ("a", "Weather2020"), ("b", "weather"), ("b", "weathermap"), ("b", "weather_x1"), ("b", "wind1")):
        rows.write.partitionBy("resource").parquet(str(tmp_path / root / name))
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert [s.rpartition("/")[2] for root in roots for s in tables.weather_sets(spark, root, "weather")] == ["Weather2020", "weather2019", "weather"]
    every = tables.read_weather(spark, roots)
    assert every.count() == 12 and every.schema["latitude"].dataType.simpleString() == "double"
    wind = tables.read_weather(spark, roots, resources=["wind"])
    assert wind.count() == 6 and {x.resource for x in wind.collect()} == {"wind"}
    filters = [line for line in plan(wind).splitlines() if "PartitionFilters" in line]
    assert len(filters) == 3 and all("resource" in line.split("PartitionFilters: [")[1].split("]")[0] for line in filters)
    assert tables.read_weather(spark, roots[1], prefix="wind").count() == 4
    with pytest.raises(ValueError, match="no sets named tide"):
        tables.read_weather(spark, roots, prefix="tide")


def test_committed_segments(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = lambda segment, cost, n=4: spark.createDataFrame([(float(k), 0.0, cost, segment) for k in range(n)], "latitude double, longitude double, lcoa_per_t double, segment int")
    for segment, cost in ((0, 1.0), (1, 2.0), (1, 3.0), (0, 1.0)):
        sinks.commit_segments(rows(segment, cost), path)
    got = lambda: collections.Counter((x.segment, x.lcoa_per_t) for x in spark.read.parquet(path).collect())
    assert got() == {(0, 1.0): 4, (1, 3.0): 4}
    failing = rows(1, 9.0).withColumn("lcoa_per_t", F.when(F.col("latitude") > 2, F.raise_error(F.lit("lost"))).otherwise(F.col("lcoa_per_t")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.commit_segments(failing, path)
    assert got() == {(0, 1.0): 4, (1, 3.0): 4}
    with pytest.raises(ValueError, match="segment"):
        sinks.commit_segments(rows(1, 9.0).drop("segment"), path)


def test_order_holds_over_files(spark, tmp_path):
    places = [(float(k * 7 % 101), float(k), k) for k in range(400)]
    requested = spark.createDataFrame([*places, (0.0, 0.0, 999)], "latitude double, longitude double, file_order long")
    done = spark.createDataFrame([(a, b, float(k), "EUR") for a, b, k in places if k % 3] + [(-1.0, -1.0, 0.0, "EUR")], "latitude double, longitude double, lcoa_per_t double, currency string").repartition(7)
    path = str(tmp_path / "ordered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.rewrite_in_order(done, requested, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "ordered").glob("part-*.parquet"))
    assert len(files) > 1
    in_order = [x.lcoa_per_t for f in files for x in spark.read.parquet(str(f)).collect()]
    assert in_order == [float(k) for k in range(400) if k % 3]
    assert spark.read.parquet(path).columns == ["latitude", "longitude", "currency", "lcoa_per_t"]


def test_each_request_of_a_place_is_written(spark):
    """Cells at one place: a row for each, as in the query's SQL."""
    from terrasift import file_queries

    rows = spark.createDataFrame([(1.0, 2.0, 5.0, 0, 1), (1.0, 2.0, 6.0, 1, 2), (3.0, 4.0, 7.0, 0, 3)], "latitude double, longitude double, lcoa_per_t double, file_rank int, row_no long")
    cells = spark.createDataFrame([(1, 1.0, 2.0, 9.0), (2, 1.0, 2.0, 9.0), (3, 1.0, 2.0, 0.0), (4, 3.0, 4.0, 9.0), (5, 8.0, 8.0, 9.0)], "cell_id long, latitude double, longitude double, max_capacity_mw double")
    got = file_queries.rewritten_results(rows, cells).collect()
    assert sorted((r.row_no, r.lcoa_per_t) for r in got) == [(2, 6.0), (2, 6.0), (3, 7.0)]


def test_bands_are_pruned(spark, data, tmp_path):
    cells = load(spark, data, "cells")
    sinks.write_bands(cells, str(tmp_path / "banded"))
    segment = tables.read_bands(spark, str(tmp_path / "banded"), -90, 0)
    text = plan(segment)
    assert "PartitionFilters: [" in text and "band" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(x.cell_id for x in segment.collect()) == sorted(x.cell_id for x in cells.where("longitude >= -90 and longitude < 0").collect())
    assert {f.parent.name for f in (tmp_path / "banded").rglob("*.parquet")} >= {"band=3", "band=5"}
    whole = tables.read_bands(spark, str(tmp_path / "banded"))
    assert whole.count() == cells.where("longitude < 180").count() and whole.columns == cells.columns


def test_what_was_written_is_compared_in_passing(spark, tmp_path, monkeypatch):
    compiled = spark.createDataFrame([("wind", 1.5), ("solar", None), ("x", 2.0)], "tech string, capital_cost double")
    seen = sinks.write_observed(compiled, str(tmp_path / "a"))
    assert seen["rows"] == 3 and sinks.write_compiled(compiled, str(tmp_path / "b")).collect() == []
    write = sinks.write_table
    monkeypatch.setattr(sinks, "write_table", lambda df, path, *a: write(df.withColumn("capital_cost", F.col("capital_cost") + 1), path, *a))
    assert {(x.tech, x.capital_cost, x.read) for x in sinks.write_compiled(compiled, str(tmp_path / "c")).collect()} == {("wind", 1.5, 2.5), ("x", 2.0, 3.0)}


def test_preflight_sees_a_run(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, None), (2.0, "a")], "latitude double, v string")
    check = results.Preflight()
    check.watch("places", rows, ("latitude", "longitude", "v")).write.parquet(str(tmp_path / "p"))
    check.watch("none", rows.limit(0), ("latitude",)).write.parquet(str(tmp_path / "n"))
    got = {x.table: (x.missing, x.rows, x.nulls) for x in check.report(spark).collect()}
    assert got == {"places": ("longitude", 2, 1), "none": ("", 0, 0)}


def test_sheets_of_any_components(spark, tmp_path):
    hours = [(1, n, f"2024-01-01 0{h}:00:00", float(h)) for n in ("tide", "wind 2", "grid") for h in range(3)] + [(2, "grid", "2024-01-01 00:00:00", 9.0)]
    series = spark.createDataFrame(hours, "cell_id long, name string, t string, p double").withColumn("ts", F.to_timestamp("t")).drop("t")
    wide = results.pivoted(series, "p", 2.0)
    assert wide.columns == ["cell_id", "ts", "grid", "tide", "wind 2"]
    assert {(x.cell_id, x.grid, x.tide) for x in wide.collect()} == {(1, 0.0, 0.0), (1, 2.0, 2.0), (1, 4.0, 4.0), (2, 18.0, None)}
    with pytest.raises(ValueError, match="more than 2"):
        results.pivoted(series, "p", most=2)
    assert results.pivoted(series.limit(0), "p").columns == ["cell_id", "ts"]
    parts = spark.createDataFrame([(1, "a", 2.0, "power", None), (2, "b", None, None, "water")], "cell_id long, name string, rated_mw double, source string, other string")
    sinks.write_sheets({"wide": wide, "parts": parts}, str(tmp_path / "sheets"))
    back = tables.read_sheets(spark, str(tmp_path / "sheets"))
    assert set(back) == {"wide", "parts"}
    for name, df in (("wide", wide), ("parts", parts)):
        assert sorted(map(repr, back[name].select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    text = plan(tables.read_sheet(spark, str(tmp_path / "sheets"), "parts"))
    assert "sheet" in text.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError, match="no rows in none"):
        tables.read_sheet(spark, str(tmp_path / "sheets"), "none")


def test_a_sheet_s_row_stays_a_row(spark, tmp_path, monkeypatch):
    """Rows alike in their keys, or without any, all come back, and reading groups nothing; a wide table is many tasks."""
    same = spark.createDataFrame([(1, "a", 1.0, "x", 3), (1, "a", 1.0, "x", 3), (None, None, None, None, 4)], "cell_id long, name string, v double, t string, n int")
    bare = spark.createDataFrame([(1.0,), (2.0,), (None,)], "`a.b` double")
    sinks.write_sheets({"same": same, "bare": bare, "none": bare.limit(0)}, str(tmp_path / "sheets"))
    assert spark.read.parquet(str(tmp_path / "sheets")).where("columns is null").count() == 6
    back = tables.read_sheets(spark, str(tmp_path / "sheets"))
    assert back.keys() == {"same", "bare"} and back["same"].columns == same.columns
    for name, df in (("same", same), ("bare", bare)):
        assert sorted(map(repr, map(tuple, back[name].collect()))) == sorted(repr(tuple(float(x) if c == "n" else x for c, x in zip(df.columns, r))) for r in df.collect())
        assert "Exchange" not in plan(back[name])
    with pytest.raises(ValueError, match="more than 3 columns"):
        tables.read_sheets(spark, str(tmp_path / "sheets"), most=3)
    monkeypatch.setattr(results, "TASK_ROWS", 50)
    series = spark.range(1000).select((F.col("id") % 200).alias("cell_id"), F.concat(F.lit("n"), (F.col("id") % 5).cast("string")).alias("name"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1.0).alias("p"))
    assert results.pivoted(series, "p").rdd.getNumPartitions() == 20


def test_file_order_is_a_number(spark, tmp_path):
    """Rows of several files, of which one is cut in blocks, come in order; the last value is found without sorting rows."""
    from terrasift.operators import costs

    folder = tmp_path / "a b%20c.csv"
    folder.mkdir()
    for k, n in enumerate((3, 4000, 1)):
        (folder / f"part-{k}.csv").write_text("lat,lon,tech,interest_rate,build_cost_multiplier,at\n" + "".join(f"{r % 2}.0,0.0,{'HB' if r % 3 else 'wind'},{r / 8 if k < 2 else ''},{k}.5,{k * 10000 + r}\n" for r in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        read = tables.read_spatial_costs(spark, str(folder))
        assert read.rdd.getNumPartitions() > 4 and dict(read.dtypes)["file_order"] == "decimal(38,0)"
        assert [int(r.at) for r in read.orderBy("file_order").select("at").collect()] == [0, 1, 2, *range(10000, 14000), 20000]
        last = costs.tech_overrides(read.withColumn("cell_id", F.col("lat")))
        got = {(r.cell_id, r.tech): (r.interest_rate, r.build_cost_multiplier) for r in last.collect()}
        text = plan(last)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(0.0, "wind"): (3996 / 8, 2.5), (1.0, "wind"): (3999 / 8, 1.5), (0.0, "ammonia_synthesis"): (3998 / 8, 1.5), (1.0, "ammonia_synthesis"): (3997 / 8, 1.5)}
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_both_overrides_read_their_table_once(spark, data):
    """Same rows as by two aggregates of the table, with nulls and a cell without a technology; the query's own plan doesn't read it again."""
    from terrasift.operators import costs

    r = random.Random(9)
    some = lambda: r.choice((None, r.randrange(100) / 8))
    rows = [(r.randrange(12), r.choice(("wind", "solar", None)), some(), some(), some(), some(), k) for k in r.sample(range(10**12), 300)] + [(99, None, None, None, None, 2.0, 5)]
    spatial = spark.createDataFrame(rows, "cell_id long, tech string, interest_rate double, build_cost_multiplier double, land_cost_usd_per_km2_year double, water_cost_usd_per_m3 double, file_order long")
    for got, want in zip(costs.both_overrides(spatial), (costs.tech_overrides(spatial), costs.location_overrides(spatial)), strict=True):
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "l_tax" in plan(QUERIES["headline_splits"](spark, data)) and "l_tax" not in plan(QUERIES["rescaled_splits"](spark, data))


def test_adjacent_cluster_query_by_force(spark, data):
    """All cells of the registered query against distances of all neighbours anew for every merge."""
    from test_operators import merged_by_force

    frame = weather.weather_frame(weather.dense_hours(load(spark, data, "weather"))).na.fill(0.0)
    hours = collections.defaultdict(list)
    for x in frame.select("cell_id", "hour_index", "solar", "wind").collect():
        hours[x.cell_id].append((x.hour_index, x.solar, x.wind))
    got = collections.defaultdict(list)
    for x in QUERIES["adjacent_cluster"](spark, data).collect():
        got[x.cell_id].append((x.cluster, x.weights, x.solar, x.wind))
    assert got.keys() == hours.keys()
    for cell in sorted(hours)[:6]:
        values = np.array([v[1:] for v in sorted(hours[cell])])
        want = merged_by_force(values, np.ones(len(values)), len(values) // 6)
        mine = sorted(got[cell])
        assert [w for _, w, _, _ in mine] == [w for _, w in want] and np.allclose([m[2:] for m in mine], [v for v, _ in want], atol=1e-4)
    assert all(sum(x[1] for x in rows) == len(hours[c]) for c, rows in got.items())


def test_hours_of_a_series_are_made_where_it_is(spark, data):
    """Rows alone are shuffled: frames, blocks, windows and clusters move no hour, and tasks follow the hours."""
    rows = load(spark, data, "weather")
    dense = weather.dense_hours(rows)
    given = plan(rows).count("Exchange ") + 1
    frame = weather.weather_frame(dense)
    order = Window.partitionBy("cell_id").orderBy("hour_index")
    for df in (dense, frame, weather.block_mean(dense, 7), weather.block_mean_strict(dense, 6), frame.withColumn("n", F.lead("wind").over(order)), weather.cluster_hours(frame.na.fill(0.0, ["solar", "wind"]), ["solar", "wind"], 6)):
        assert plan(df).count("Exchange ") <= given, plan(df)
    for name in ("weather_frame", "block_mean", "strict_block_mean", "block_sum_weights", "neighbour_distance", "adjacent_cluster", "backstop_energy", "capacity_sweep"):
        assert plan(QUERIES[name](spark, data)).count("Exchange ") <= given, name
    few, weather.TASK_ROWS = weather.TASK_ROWS, 1000
    try:
        assert weather.dense_hours(rows).rdd.getNumPartitions() > 4
    finally:
        weather.TASK_ROWS = few


def test_odd_hours_and_series(spark):
    """Nulls, hours beside the calendar, rows that come twice, a series without any hour: as a join with the calendar has them."""
    hour = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    rows = [(1, "wind", hour(2), 0.5), (1, "wind", hour(2), 0.7), (1, "wind", hour(3, 30), 0.9), (1, "wind", None, 0.8), (1, "solar", hour(5), None), (1, "solar", hour(0), 0.1), (2, "wind", None, 0.3), (None, "wind", hour(1), 0.4), (3, None, hour(1), 0.4)]
    series = spark.createDataFrame(rows, "cell_id long, resource string, ts timestamp, cf double")
    span = series.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    hours = span.select(F.posexplode(F.expr("sequence(first, last, interval 1 hour)")).alias("hour_index", "ts"))
    want = series.select("cell_id", "resource").distinct().crossJoin(hours).join(series, ["cell_id", "resource", "ts"], "left").select("cell_id", "resource", "ts", "hour_index", F.coalesce("cf", F.lit(0.0)).alias("cf"))
    assert collections.Counter(weather.dense_hours(series).collect()) == collections.Counter(want.collect()) and want.count() == 5 * 6 + 1
    assert weather.dense_hours(series.limit(0)).count() == 0


def test_frames_of_places_with_several_cells(spark):
    """Locations at one point, and cells at one place: each hour's highest value, from a frame made once."""
    hour = lambda h: datetime.datetime(2024, 1, 1, h)
    series = spark.createDataFrame([(1, "wind", hour(0), -0.5), (2, "wind", hour(1), 0.4), (3, "solar", hour(2), 0.2), (4, "wind", hour(3), 0.6)], "cell_id long, resource string, ts timestamp, cf double")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 10.0, 10.0)], "cell_id long, latitude double, longitude double")
    sites = spark.createDataFrame([(7, 1.0, 1.0), (8, -1.0, 0.0), (9, 9.0, 9.0), (10, 1.0, 9.0)], "cell_id long, latitude double, longitude double")
    got = {(x.cell_id, x.hour_index): (x.solar, x.wind) for x in weather.location_frame(sites, series, places, wake=1.0).collect()}
    point = {0: (None, 0.0), 1: (None, 0.4), 2: (None, 0.0), 3: (None, 0.0)}
    assert got == {**{(c, h): v for c in (7, 8) for h, v in point.items()}, **{(9, h): (0.2 if h == 2 else 0.0, None) for h in range(4)}}


def test_merging_zeros_at_once_changes_nothing():
    """Many equal rows, with and without zeros, against distances of all neighbours anew for every merge."""
    from test_operators import merged_by_force

    r = np.random.Generator(np.random.PCG64(7))
    for k in range(60):
        values = np.round(r.random((40, 1 + k % 3)), 1 if k % 2 else 9) * (r.random((40, 1)) < 0.4)
        for n in (3, 12, 20, 35):
            want = merged_by_force(values, np.ones(40), n)
            got, weights = weather.merge_neighbours(values, np.ones(40), n)
            if k % 2 == 0:  # rounded ones have ties that rounding of sums decides
                assert weights.tolist() == [w for _, w in want] and np.allclose(got, [v for v, _ in want])


def test_pairs_follow_places(spark):
    """Many rows and probes at few places: same rows as by force, from pairs of places."""
    r = random.Random(5)
    place = lambda: (r.randrange(4) * 0.1, r.randrange(4) * 0.1)
    probes, rows = [(k, *place()) for k in range(60)], [(*place(), k if k % 9 else None, r.choice("ab"), r.choice([None, 1.0, 2.0, 3.0])) for k in range(300)]
    probe, table = spark.createDataFrame(probes, "id long, latitude double, longitude double"), spark.createDataFrame(rows, "latitude double, longitude double, file_order long, tech string, v double")
    near = lambda p: [x for x in rows if abs(x[0] - p[1]) <= 0.125 and abs(x[1] - p[2]) <= 0.125]
    first = lookup.first_within(probe, table)
    assert {x.id: (x.file_order, x.tech, x.v) for x in first.collect()} == {p[0]: min(x[2:] for x in near(p) if x[2] is not None) for p in probes}
    merged = {}
    for p in probes:
        for tech in {x[3] for x in near(p)}:
            merged[p[0], tech] = max(((x[2], x[4]) for x in near(p) if x[3] == tech and x[2] is not None and x[4] is not None), default=(0, None))[1]
    assert {(x.id, x.tech): x.v for x in lookup.merged_within(probe, table, ["tech"], ["v"]).collect()} == merged
    met, pairs = lookup.within_tolerance, []
    lookup.within_tolerance = lambda *a, **k: pairs.append(met(*a, **k)) or pairs[-1]
    try:
        lookup.first_within(probe, table)
        lookup.merged_within(probe, table, ["tech"], ["v"])
    finally:
        lookup.within_tolerance = met
    assert [x.count() <= 16 * 9 * n for x, n in zip(pairs, (1, 2), strict=True)] == [True, True]


def test_few_buses_are_no_shuffle_key(spark, data):
    """A plant's ports have a few names; dispatch isn't shuffled by them."""
    text = plan(QUERIES["bus_balance"](spark, data))
    assert text.count("BroadcastHashJoin") >= 2 and not re.search(r"hashpartitioning\((name|bus)#\d+, ", text)


def test_geojson_feed_is_json(spark, data):
    assert all(json.loads(x.geojson)["type"] == "Polygon" for x in QUERIES["cell_geojson_feed"](spark, data).limit(20).collect())
