"""Readers and writers on files."""

import json

import pytest
from pyspark.sql import functions as F

from terrasift.schemas import CELLS, require_columns
from terrasift.sources import sinks, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_plant_and_techs(spark, tmp_path):
    for name, text in {"buses": "name,carrier\npower,AC\n", "generators": "name,bus,p_nom_extendable,capital_cost\nwind,power,True,5\n", "links": "name,bus0,bus1,efficiency\ne,power,h,0.5\n", "stores": "name,bus,e_cyclic\ns,h,True\n", "loads": "name,bus,p_set\nl,h,1.5\n"}.items():
        write(tmp_path / f"{name}.csv", text)
    plant = tables.read_plant(spark, str(tmp_path))
    assert plant["links"].first().efficiency == 0.5 and plant["generators"].first().p_nom_extendable is True
    rows = [{"scenario": "a", "name": "HB", "component_type": "Link", "overnight_cost_per_mw": 1.0, "carriers_in": {"power": 2.0}}, {"scenario": "a", "name": "x", "component_type": "pump"}, {"scenario": "b", "name": "s", "component_type": "store", "overnight_cost_per_mw": 1.0}]
    path = write(tmp_path / "techs.json", "\n".join(map(json.dumps, rows)))
    techs = tables.read_techs(spark, path)
    assert tables.read_techs(spark, path, "a").first().name == "ammonia_synthesis"
    assert {(r.name, r.reason) for r in tables.rejected_techs(techs).collect()} == {("x", "unknown component_type"), ("s", "no overnight cost")}
    with pytest.raises(ValueError, match="missing columns: nope"):
        require_columns(techs, "nope")


def test_optional_tables(spark, tmp_path):
    assert tables.read_spatial_costs(spark, str(tmp_path / "none.csv")).count() == 0
    assert tables.read_cells(spark, str(tmp_path / "none.csv"), str(tmp_path / "old.csv")).count() == 0
    old = write(tmp_path / "old.csv", "Latitude,Longitude,availability,area,wind_availability,solar_availability,onshore_land_pct\n1,2,1,3,0.5,nan,50\n")
    cells = tables.read_cells(spark, str(tmp_path / "none.csv"), old).first()
    assert (cells.latitude, cells.solar_availability) == (1.0, None)
    assert tables.read_legacy_cells(spark, old).count() == 1
    costs = tables.read_spatial_costs(spark, write(tmp_path / "c.csv", "Lat,LON,Tech,Interest_Rate\n1,2,HB,0.1\n"))
    assert costs.first().tech == "ammonia_synthesis" and "file_order" in costs.columns
    with pytest.raises(ValueError, match="lon"):
        tables.read_locations(spark, write(tmp_path / "l.csv", "lat,x\n1,2\n"))


def test_site_weather_and_datasheet(spark, tmp_path):
    site = tables.read_site_weather(spark, write(tmp_path / "w.csv", "t,wind,solar\nt0,0.1,0.2\nt1,0.3,0.4\n"))
    assert site.columns == ["wind", "solar", "grid", "ramp_dummy"] and (site.first().grid, site.first().ramp_dummy) == (0.0, 1.0)
    sheet = write(tmp_path / "d.csv", "Year,Est,value\n2030,ctrl,1\n2030,low,2\n2050,ctrl,3\n")
    assert [r.value for r in tables.read_datasheet(spark, sheet).collect()] == ["1"]
    with pytest.raises(ValueError, match="no segment files"):
        tables.read_segments(spark, [])


def test_segments(spark, tmp_path):
    paths = [write(tmp_path / f"{i}.csv", f"latitude,longitude{',extra' * i}\n{i},2{',9' * i}\n") for i in range(2)]
    got = {r.file_rank: r for r in tables.read_segments(spark, paths).collect()}
    assert got[0].extra is None and got[1].extra == "9"


def test_geojson(spark):
    ring = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    features = [{"type": "Feature", "properties": {"NAME": "P"}, "geometry": {"type": "Polygon", "coordinates": [ring(0, 9), ring(3, 4)]}}, {"type": "Feature", "properties": {"country": "?", "ADMIN": "M"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring(20, 21)], [ring(30, 31)]]}}]
    df = spark.createDataFrame([(json.dumps(f), i) for i, f in enumerate(features)], "feature string, polygon_order int")
    edges = tables.country_edges(df)
    assert {(r.country, r.part): r["count"] for r in edges.groupBy("country", "part").count().collect()} == {("P", 0): 8, ("M", 0): 4, ("M", 1): 4}
    assert tables.outer_rings(df).count() == 3


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([tuple(float(i + j) for j in range(21)) for i in range(5)], CELLS)
    sinks.write_cells(cells, str(tmp_path / "cells.parquet"))
    assert tables.read_cells(spark, str(tmp_path / "cells.parquet")).count() == 5
    sinks.write_table(cells, str(tmp_path / "cells.csv"), "csv")
    assert tables.read_cells(spark, str(tmp_path / "cells.csv")).count() == 5
    compiled = spark.createDataFrame([("wind", 1.5)], "tech string, capital_cost double")
    assert sinks.write_compiled(compiled, str(tmp_path / "compiled")).count() == 0
    for segment in (1, 2):
        sinks.append_results(cells.select("latitude", F.lit(segment).alias("segment")), str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 10
    sinks.write_sheets({"a": compiled, "b": cells}, str(tmp_path / "sheets"))
    assert (tmp_path / "sheets" / "sheet=a").is_dir() and tables.read_sheet(spark, str(tmp_path / "sheets"), "a").count() == 1
    named = sinks.with_currency(spark.createDataFrame([(1.0, 2.0)], "lcoa_per_t double, area double"), "EUR")
    assert named.columns == ["lcoa_eur_per_t", "area"]
    pairs = sinks.key_values(spark.createDataFrame([(1.0, 2.0, 5.0)], "latitude double, longitude double, x double")).first()
    assert (pairs.tag, pairs.metric, pairs.value) == ("lat1.00_lon2.00", "x", "5.0")
    labels = sinks.weather_labels(spark.createDataFrame([(1, 0, 0.1, 0.2)], "cell_id long, hour_index int, solar double, wind double")).first()
    assert (labels.t, labels.s, labels.w) == ("t0", 0.1, 0.2)
