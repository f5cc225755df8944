"""Operators on hand-made tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.fixtures import TECH_VALUES
from terrasift.functions import costs as cost_functions
from terrasift.functions import recipes
from terrasift.functions.geometry import cell_area_km2, coarse_latitude, coarse_longitude, solar_density
from terrasift.functions.names import cap_columns, component_label, metric_column, normalize_name, with_units
from terrasift.operators import analysis, checks, costs, economics, land, lookup, results, sizing, weather
from terrasift.schemas import CELLS



#: Annual costs of some components of the default plant.
COMPILED = {
    "solar": 46458.577477460414,
    "wind": 117253.70087494951,
    "electrolysis": 64474.141402848385,
    "ammonia_synthesis": 1297855.8302094957,
    "compressed_hydrogen_store": 3151.9812063158474,
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def close(a, b, tolerance=1e-9):
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)


def test_annuities(spark):
    crf = lambda r, n: one(spark, cost_functions.capital_recovery(F.lit(r), F.lit(n)))[0]
    assert close(crf(0.1, 20.0), 0.1 * 1.1**20 / (1.1**20 - 1)) and close(crf(0.0, 20.0), 0.05)
    with pytest.raises(Exception, match="lifetime must be positive"):
        crf(0.1, 0.0)
    with pytest.raises(Exception, match="efficiency must be positive"):
        one(spark, cost_functions.to_input_basis(F.lit(1.0), F.lit(0.0)))


def test_compiled_costs(spark):
    """Annual costs of the default technologies, worked out by hand; links are per input."""
    techs = spark.sql(f"select * from {TECH_VALUES}")
    for r in costs.base_costs(techs).collect():
        recovery = r.rate * (1 + r.rate) ** r.lifetime / ((1 + r.rate) ** r.lifetime - 1)
        assert close(r.capital_cost, COMPILED.get(r.tech, r.capital_cost))
        assert close(r.capital_cost, r.overnight * (recovery + r.om) * (r.eff if r.component_type == "link" else 1))
    assert costs.check_cost_split(techs).count() == 0
    plant = techs.select(F.col("tech").alias("name")).where("tech <> 'wind'")
    assert [r.tech for r in costs.unmatched(techs, plant).collect()] == ["wind"]


def test_depth_multipliers(spark):
    wind = {0.0: 1.0, 30.0: 1.55, 60.0: 1.8, 150.0: 2.0625, 300.0: 2.5, 800.0: 2.9167, 1500.0: 3.5, 4000.0: 3.5}
    plant = {0.0: 1.0, 30.0: 1.2, 60.0: 1.3, 150.0: 1.4875, 300.0: 1.8, 800.0: 2.0917, 1500.0: 2.5, 4000.0: 2.5}
    for tech, table in (("wind", wind), ("electrolysis", plant)):
        for depth, value in table.items():
            assert close(one(spark, cost_functions.depth_multiplier(F.lit(depth), F.lit(tech)))[0], value)
    assert one(spark, cost_functions.depth_multiplier(F.lit(None).cast("double"), F.lit("wind")))[0] == 1


def test_cells_cover_the_sphere(spark):
    area = spark.range(-90, 90).select(F.sum(cell_area_km2(F.col("id"))) * 360).first()[0]
    assert close(area, 4 * math.pi * 6371**2)
    grid = spark.range(3600).select(coarse_latitude(F.col("id")).alias("a"), F.floor(F.round(90 - F.col("id") * 0.05, 6)).alias("b"))
    assert grid.where("a <> b").count() == 0
    assert spark.range(7200).select(coarse_longitude(F.col("id")).alias("a"), F.floor(F.round(F.col("id") * 0.05 - 180, 6)).alias("b")).where("a <> b").count() == 0
    assert close(one(spark, solar_density(F.lit(0.0), km2_per_mw=0.02))[0], 50.0)


def test_recipes(spark):
    ins, outs = recipes.recipe_per_output(F.lit("power"), F.lit("hydrogen"), F.lit("water"), F.lit(0.5), F.lit(-0.1))
    r = one(spark, ins.alias("i"), outs.alias("o"), recipes.overall_efficiency(ins, outs).alias("e"), recipes.first_efficiency(ins, outs, F.lit("power"), F.lit("hydrogen")).alias("f"), recipes.second_efficiency(ins, outs, F.lit("power"), F.lit("water")).alias("s"))
    assert r.i == {"power": 2.0, "water": 0.2} and r.o == {"hydrogen": 1.0} and close(r.e, 1 / 2.2) and close(r.f, 0.5) and close(r.s, -0.1)
    techs = spark.createDataFrame([("e", {"power": 2.0, "heat": 1.0}, {"hydrogen": 1.0}, 0.9)], "tech string, carriers_in map<string,double>, carriers_out map<string,double>, overall_efficiency double")
    links = spark.createDataFrame([("e", "power", "hydrogen", "water", 0.4, -0.1)], "name string, bus0 string, bus1 string, bus2 string, efficiency double, efficiency2 double")
    assert {(x.problem, x.detail) for x in costs.check_recipes(techs, links).collect()} == {("extra in", "heat"), ("missing in", "water"), ("amount in", "power"), ("efficiency", "overall_efficiency")}


def test_names(spark):
    r = one(spark, normalize_name(F.lit("HB")), normalize_name(F.lit("battery_storage")), normalize_name(F.lit("battery_storage"), True), normalize_name(F.lit("new")), normalize_name(F.lit(None).cast("string")), component_label(F.lit("lcoa_component_hydrogen_store_eur_per_t")))
    assert tuple(r) == ("ammonia_synthesis", "battery_storage", "battery", "new", None, "Hydrogen Store")
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "EUR")], "wind double, ammonia double, lcoa_eur_per_t double, currency string")
    assert with_units(df).columns == ["wind_mw", "ammonia_mwh", "lcoa_eur_per_t", "currency"] and metric_column(df) == "lcoa_eur_per_t"
    assert cap_columns(["max_power_solar_mw", "max_energy_x_mwh", "max_power_mw"]) == [("max_power_solar_mw", "solar", "power"), ("max_energy_x_mwh", "x", "energy")]


def test_points_in_polygons(spark):
    """Borders belong to the first polygon; holes are outside."""
    boxes = [("A", 0, -10.0, 40.0), ("B", 1, 40.0, 80.0)]
    edges = [(c, o, x, y, u, v) for c, o, w, e in boxes for x, y, u, v in ((w, -10.0, w, 20.0), (w, 20.0, e, 20.0), (e, 20.0, e, -10.0), (e, -10.0, w, -10.0))]
    edges += [("A", 0, *s) for s in ((0.0, 0.0, 0.0, 5.0), (0.0, 5.0, 5.0, 5.0), (5.0, 5.0, 5.0, 0.0), (5.0, 0.0, 0.0, 0.0))]
    points = {1: (40.0, 5.0, "A"), 2: (41.0, 5.0, "B"), 3: (2.0, 2.0, None), 4: (0.0, 2.0, "A"), 5: (-10.0, 20.0, "A"), 6: (90.0, 0.0, None), 7: (-5.0, -5.0, "A")}
    got = lookup.locate_country(spark.createDataFrame([(i, x, y) for i, (x, y, _) in points.items()], "id long, x double, y double"), spark.createDataFrame(edges, "country string, polygon_order int, x1 double, y1 double, x2 double, y2 double"))
    assert {r.id: r.country for r in got.collect()} == {i: c for i, (_, _, c) in points.items()}


def test_lookups(spark):
    axis = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "axis_value double")
    values = spark.createDataFrame([(-5.0,), (0.5,), (2.0,), (2.1,), (9.0,), (None,)], "value double")
    assert {r.value: r.nearest for r in lookup.nearest_on_axis(values, axis).collect()} == {-5.0: 0.0, 0.5: 0.0, 2.0: 1.0, 2.1: 3.0, 9.0: 3.0}
    assert {r.value: r.nearest for r in lookup.nearest_on_axis(values, axis, "greatest").collect()}[0.5] == 1.0
    probe = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "id long, latitude double, longitude double")
    rows = spark.createDataFrame([(0.125, -0.125, 2, "b"), (0.1, 0.0, 1, "a"), (0.126, 0.0, 0, "far"), (0.00001, 0.0, 9, "exact")], "latitude double, longitude double, file_order int, v string")
    assert [(r.id, r.v) for r in lookup.first_within(probe, rows).collect()] == [(1, "a")]
    assert {r.id: r.v for r in lookup.exact_lookup(probe, rows).collect()} == {1: "exact", 2: None}


def test_caps(spark):
    cells = spark.createDataFrame([(1, 5.0, None, 9.0), (2, None, None, None), (3, -1.0, 2.0, 1.0)], "cell_id long, max_power_solar_mw double, max_energy_ammonia_mwh double, wind_max_capacity double")
    got = {(r.cell_id, r.tech): r.cap for r in land.extract_caps(cells).collect()}
    assert got == {(1, "solar"): 5.0, (1, "wind"): 9.0, (2, "solar"): 0.0, (2, "wind"): 0.0, (3, "solar"): 0.0, (3, "wind"): 1.0, (3, "ammonia"): 2.0}
    plain = spark.createDataFrame([(1, 7.0), (2, None)], "cell_id long, max_capacity double")
    assert {(r.cell_id, r.tech): r.cap for r in land.extract_caps(plain).collect()} == {(1, "solar"): 7.0, (1, "wind"): 7.0}
    caps = spark.createDataFrame([(1, "solar", "power", 5.0), (1, "wind", "power", 3.0), (2, "solar", "power", 4.0), (2, "solar_tracking", "power", 6.0)], "cell_id long, tech string, kind string, cap double")
    shared = {r.cell_id: r for r in land.resolve_shared_caps(caps, fixed=("solar",)).collect()}
    assert (shared[1].solar_cap_mw, shared[1].solar_tracking_cap_mw, shared[1].shared_solar_cap_mw, shared[1].non_wind_cap_mw) == (0.0, 5.0, 5.0, 5.0) and shared[2].shared_solar_cap_mw is None


def test_segments_and_retries(spark):
    requested = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "latitude double, longitude double")
    assert results.retry_list(requested, requested.limit(8)).count() == 12
    rows = spark.createDataFrame([(1.0, 1.0, 0, 5, "a"), (1.0, 1.0, 1, 0, "b"), (1.0, 1.0, 1, 1, "c"), (2.0, 1.0, 0, 0, "d")], "latitude double, longitude double, file_rank int, row_no long, v string")
    assert sorted(r.v for r in results.combine_segments(rows).collect()) == ["c", "d"]
    mixed = spark.createDataFrame([(1, 2, 3, 4, 5)], "z int, interest_rate_x int, wind_mw int, latitude int, lcoa_per_t int")
    assert results.order_columns(mixed).columns == ["latitude", "lcoa_per_t", "wind_mw", "interest_rate_x", "z"]
    old = results.backfill_currency(spark.createDataFrame([(1.0,)], "lcoa_usd_per_t double"), " eur ").first()
    assert (old.lcoa_per_t, old.currency) == (1.0, "EUR")
    report = {r.table: (r.missing, r.rows) for r in results.preflight({"a": (requested, ("latitude", "x")), "b": (rows, ("v",))}).collect()}
    assert report == {"a": ("x", 20), "b": ("", 4)}


def test_cells_table(spark):
    cover = spark.createDataFrame([(300, 20, 0, 60.0), (301, 21, 0, 40.0), (301, 21, 16, 100.0), (3590, 0, 0, 100.0)], "y_index int, x_index int, modis_class int, percentage double")
    depth = spark.createDataFrame([(75.0, -179.0, 12.0)], "latitude double, longitude double, depth_m double")
    got = land.build_cells(cover, depth).collect()
    assert land.build_cells(cover, depth).columns == CELLS.names and [(r.latitude, r.longitude) for r in got] in ([(75.0, -179.0), (74.0, -179.0)], [(74.0, -179.0), (75.0, -179.0)])
    for r in got:
        assert 0 <= r.wind_availability <= 1 and close(r.onshore_area_km2 + r.offshore_area_km2, r.area) and r.bathymetry_depth_m == 12.0
    assert land.build_cells(cover).where("bathymetry_depth_m is not null").count() == 0


def test_weather(spark):
    rows = [(1, r, f"2024-01-01 0{h}:00:00", 0.1 * h) for r in ("wind", "solar") for h in (0, 1, 3, 6)]
    series = spark.createDataFrame(rows, "cell_id long, resource string, t string, cf double").withColumn("ts", F.to_timestamp("t")).drop("t")
    dense = weather.dense_hours(series)
    assert dense.count() == 14 and close(dense.agg(F.sum("cf")).first()[0], 2.0)
    assert weather.block_mean(dense, 3).count() == 4 and weather.block_sum(dense, 7).agg(F.sum("weights")).first()[0] == 14
    for blocks in (weather.block_sum, weather.block_mean_strict):
        with pytest.raises(Exception, match="does not divide"):
            blocks(dense, 3).collect()
    assert weather.block_mean_strict(dense, 7).count() == 2
    frame = weather.weather_frame(dense)
    assert close(frame.where("hour_index = 3").first().wind, 0.3 * 0.93) and close(frame.where("hour_index = 3").first().solar_tracking, 0.3)
    clustered = weather.cluster_hours(frame, ["solar", "wind"], 2)
    assert clustered.count() == 3 and clustered.agg(F.sum("weights")).first()[0] == 7
    values, weights = weather.merge_neighbours(np.array([[0.0], [0.1], [5.0], [5.1]]), np.ones(4), 2)
    assert np.allclose(values, [[0.05], [5.05]]) and weights.tolist() == [2, 2]
    generators = spark.createDataFrame([("wind",), ("solar_tracking",), ("grid",), ("tidal",)], "name string")
    assert [r.name for r in weather.missing_profiles(generators, series).collect()] == ["tidal"]


def swept_by_force(hours, mix, demand, storage_cost):
    """(storage, cost, unmet) of one cell and mix."""
    _, wind_mw, solar_mw, mix_cost = mix
    net = [w * wind_mw + s * solar_mw - demand for w, s in hours]
    running, peak, storage = 0.0, -math.inf, 0.0
    for x in net + net:
        running += x
        peak = max(peak, running)
        storage = max(storage, peak - running)
    feasible = sum(net) >= 0
    return storage if feasible else None, mix_cost + storage * storage_cost if feasible else None, sum(max(0.0, -x) for x in net)


def test_sweep_against_brute_force(spark):
    r = np.random.Generator(np.random.PCG64(4))
    hours = {c: [(float(r.random()), float(r.random())) for _ in range(48)] for c in range(3)}
    frame = spark.createDataFrame([(c, h, w, s) for c, rows in hours.items() for h, (w, s) in enumerate(rows)], "cell_id long, hour_index int, wind double, solar double")
    mixes = [(m, float(w), float(s), w + 0.8 * s) for m, (w, s) in enumerate(itertools.product((0, 1, 2, 4), (0, 1, 3)))]
    sized = sizing.capacity_sweep(frame, mixes, 0.9, 0.1)
    got = {(x.cell_id, x.mix): x for x in sized.collect()}
    assert got.keys() == {(c, m[0]) for c in hours for m in mixes}
    for (c, m), x in got.items():
        storage, cost, unmet = swept_by_force(hours[c], mixes[m], 0.9, 0.1)
        assert (x.storage is None) == (storage is None) and close(x.unmet, unmet) and (storage is None or close(x.storage, storage) and close(x.cost, cost))
    assert sizing.best_mix(sized).count() == 3


def test_sweep_takes_all_mixes(spark):
    frame = spark.createDataFrame([(c, h, 0.5, float(h % 2)) for c in range(2) for h in range(4)], "cell_id long, hour_index int, wind double, solar double")
    grid = list(itertools.product(range(17), range(17)))
    mixes = [(m, float(w), float(s), 1.0 if m == len(grid) - 1 else 100.0) for m, (w, s) in enumerate(grid)]
    sized = sizing.capacity_sweep(frame, mixes, 0.9, 0.1)
    assert sorted((x.cell_id, x.mix) for x in sized.collect()) == [(c, m) for c in range(2) for m in range(len(grid))]
    assert sorted((x.cell_id, x.mix) for x in sizing.best_mix(sized).collect()) == [(0, 288), (1, 288)]


def test_economics(spark):
    capacity = spark.createDataFrame([(1, "wind", 10.0), (1, "electrolysis", 4.0), (1, "other", 2.0)], "cell_id long, name string, optimum double")
    prices = spark.createDataFrame([("wind", 100.0), ("electrolysis", 50.0), ("other", 7.0)], "name string, capital_cost double")
    capex = economics.capex(capacity, prices)
    opex = spark.createDataFrame([(1, "wind", 5.0)], "cell_id long, name string, opex double")
    broken = economics.cost_breakdown(capex, opex, spark.createDataFrame([(1, 1300.0)], "cell_id long, objective double"))
    r = economics.lcoa(broken, 7134.703196).first()
    assert close(r.annual_ammonia_production_t, 9999999.9995, 1e-7) and close(r.cost_share_wind_pct, 1005 / 13)
    shares = [v for k, v in r.asDict().items() if k.startswith("cost_share_")]
    assert close(sum(shares) + r.other_cost_pct, 100)
    rates = spark.createDataFrame([(1, "wind", 0.1), (1, "electrolysis", 0.05), (2, "wind", 0.2)], "cell_id long, name string, interest_rate double")
    assert {x.cell_id: round(x.interest_rate_overall, 9) for x in economics.weighted_interest_rate(rates, capacity, prices).collect()} == {1: round((100 + 10) / 1200, 9), 2: 0.2}
    rows = spark.createDataFrame([(1e6, 2e8, 3.0, None, 40.0, 30.0, 20.0, 10.0)], "annual_ammonia_production_t double, total_cost double, water_cost_per_t double, land_cost_per_t double, build_cost_pct double, tech_cost_pct double, om_cost_pct double, interest_pct double")
    x = economics.rescale_splits(rows).first()
    assert close(x.water_cost_pct + x.build_cost_pct + x.tech_cost_pct + x.om_cost_pct + x.interest_pct, 100) and x.land_cost_pct is None


def test_checks(spark):
    hours = [(1, "wind", f"2024-01-01 0{h}:00:00", p) for h, p in enumerate((0.0, 1.0, 5.0))]
    dispatch = spark.createDataFrame(hours, "cell_id long, name string, t string, p double").withColumn("ts", F.to_timestamp("t"))
    size = spark.createDataFrame([(1, "wind", 4.0)], "cell_id long, name string, optimum double")
    assert sorted(r.change for r in checks.ramp_violations(dispatch, size, 0.5).collect()) == [4.0, 5.0]
    carriers = spark.createDataFrame([("power",)], "name string")
    used = spark.createDataFrame([("power",), ("heat",), (None,)], "carrier string")
    assert [r.carrier for r in checks.missing_carriers([used, used], carriers).collect()] == ["heat"]
    battery = spark.createDataFrame([(1, "battery_pcs_charge", 10.0), (1, "battery_pcs_discharge", 9.0), (2, "battery_pcs_charge", 10.0)], "cell_id long, name string, optimum double")
    assert [r.cell_id for r in checks.battery_violations(battery, 0.9).collect()] == [2]


def test_reports(spark):
    rows = spark.createDataFrame([(float(i), 0.0, None if i % 3 else "X", float(i)) for i in range(10)] + [(50.0, 0.0, "Y", None)], "latitude double, longitude double, country string, lcoa_per_t double")
    assert [(r["rank"], r.lcoa_per_t) for r in analysis.cheapest(rows, 3).collect()] == [(1, 0.0), (2, 1.0), (3, 2.0)]
    assert {(r.bin, r.rows) for r in analysis.histogram(rows, "lcoa_per_t", 3).collect()} == {(1, 3), (2, 3), (3, 4)}
    assert [(r.column, r.nulls) for r in analysis.null_counts(rows).collect()] == [("country", 6), ("lcoa_per_t", 1)]
    assert analysis.describe(rows, "lcoa_per_t").first().p50 == 4.5
    feed = analysis.map_feed(rows).first()
    assert feed.geojson.startswith('{"type":"Polygon"') and feed.low <= feed.value <= feed.high


def merged_by_force(values, weights, n):
    """Distances of all neighbours anew for every merge; of equal ones the first."""
    rows = [(v.astype(float), float(w)) for v, w in zip(values, weights)]
    while len(rows) > max(n, 1):
        gaps = [2 * abs(b[0] - a[0]).sum() * a[1] * b[1] / (a[1] + b[1]) for a, b in zip(rows, rows[1:])]
        i = gaps.index(min(gaps))
        (a, u), (b, v) = rows[i : i + 2]
        rows[i : i + 2] = [((a * u + b * v) / (u + v), u + v)]
    return rows


@pytest.mark.parametrize("count, n", [(1, 1), (2, 1), (9, 3), (120, 20), (50, 0)])
def test_neighbours_merge_as_by_force(count, n):
    r = np.random.Generator(np.random.PCG64(count))
    values, weights = np.round(r.random((count, 2)) * 4) / 4, np.ones(count)
    got, want = weather.merge_neighbours(values, weights, n), merged_by_force(values, weights, n)
    assert np.allclose(got[0], [v for v, _ in want]) and np.allclose(got[1], [w for _, w in want])


def test_quantiles_by_counts(spark):
    r = random.Random(4)
    values = [r.choice([1.0, 2.5, -3.0, 1e9]) for _ in range(300)] + [r.gauss(0, 5) for _ in range(500)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    asked = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.999, "e": 1.0}
    got, known = analysis.quantile_row(df, "v", asked).first(), [v for v in values if v is not None and v == v]
    assert all(abs(got[k] - np.quantile(known, q)) <= 1e-9 * max(1, abs(got[k])) for k, q in asked.items())
    assert analysis.quantile_row(df.limit(0), "v", asked).first().c is None
    assert analysis.quantile_row(df.where("v = 1"), "v", asked).first().asDict() == dict.fromkeys(asked, 1.0)


@pytest.mark.parametrize("tie", ["least", "greatest", "first"])
def test_nearest_on_axis(spark, tie):
    axis, values = {7.0: 0, 1.0: 3, 1.5: 1, 40.0: 2, -2.0: 9}, [-9.0, -2.0, 1.0, 1.25, 1.3, 4.25, 23.5, 39.0, 41.0, 1e6, None]
    key = {"least": lambda v: lambda a: (abs(a - v), a), "greatest": lambda v: lambda a: (abs(a - v), -a), "first": lambda v: lambda a: (abs(a - v), axis[a])}[tie]
    got = lookup.nearest_on_axis(spark.createDataFrame([(v,) for v in values], "value double"), spark.createDataFrame(list(axis.items()), "axis_value double, position int"), tie).collect()
    assert {r.value: r.nearest for r in got} == {v: min(axis, key=key(v)) for v in values if v is not None}
    one = lookup.nearest_on_axis(spark.createDataFrame([(3.0,)], "value double"), spark.createDataFrame([(1.0, 0)], "axis_value double, position int"), tie)
    assert [tuple(r) for r in one.collect()] == [(3.0, 1.0)]


def test_errors_of_costs_and_blocks(spark):
    techs = "tech string, component_type string, overnight double, lifetime double, rate double, om double, standing_loss double, carriers_in map<string,double>, carriers_out map<string,double>"
    links = spark.createDataFrame([("a", "power", "out", None, 0.5, None), ("b", "power", "out", "heat", 0.5, 0.1)], "name string, bus0 string, bus1 string, bus2 string, efficiency double, efficiency2 double")
    row = lambda name, ins, outs: spark.createDataFrame([(name, "link", 1.0, 20.0, 0.1, 0.0, None, ins, outs)], techs)
    assert costs.compile_costs(row("a", None, None), links).first().efficiency == 0.5
    for bad, text in ((row("c", None, None), "no such link"), (row("a", {"power": 0.0}, {"out": 1.0}), "positive amount"), (row("b", None, None), "needs a recipe"), (row("b", {"power": 1.0}, {"out": 1.0}), "third bus")):
        with pytest.raises(Exception, match=text):
            costs.compile_costs(bad, links).collect()
    dense = spark.createDataFrame([(1, "wind", i, 1.0) for i in range(7)], "cell_id long, resource string, hour_index int, cf double")
    for blocks in (weather.block_sum, weather.block_mean_strict):
        with pytest.raises(Exception, match="does not divide"):
            blocks(dense, 3).collect()
    with pytest.raises(Exception, match="one row"):
        costs.location_costs(spark.createDataFrame([(1,)], "cell_id long"), spark.createDataFrame([(1, 1.0, 2.0)], "cell_id long, land_cost_usd_per_km2_year double, water_cost_usd_per_m3 double"), spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "water_usage_m3_per_t_nh3 double, water_cost_baseline_usd_per_m3 double")).collect()


def test_place_overrides_with_tolerance(spark):
    cells = spark.createDataFrame([(1, 10.0, 20.0), (2, 30.0, 40.0), (3, 50.0, 60.0)], "cell_id long, latitude double, longitude double")
    rows = [(10.00001, 20.0, "wind", 0.1, None, 1), (10.0, 20.0, "wind", 0.2, None, 2), (10.1, 20.0, "wind", 0.9, 9.0, 3), (30.1, 40.0, "solar", 0.3, 2.0, 4), (30.0, 40.2, "solar", 0.4, 2.0, 5)]
    spatial = spark.createDataFrame(rows, "latitude double, longitude double, tech string, interest_rate double, build_cost_multiplier double, file_order long")
    got = lambda **k: sorted(tuple(r) for r in costs.place_overrides(cells, spatial, **k).collect())
    assert got() == [(1, "wind", 0.2, None)]
    assert got(tolerance=0.125) == [(1, "wind", 0.2, None), (2, "solar", 0.3, 2.0)]
