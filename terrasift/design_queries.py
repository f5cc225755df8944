"""Queries of cost compilation, lookups of weather and overrides, series, and detailed result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.names import metric_column, with_units
from .operators import analysis, checks, costs, land, lookup, results, weather
from .queries import _CRF, _DENSE, _TECH_LAST
from .registry import query
from .sources.folders import new_path

_ANNUAL = f"overnight*({_CRF.format(r='rate', n='lifetime')}+om)"

# --- costs ---------------------------------------------------------------------------------------------------------------


def _with_recipes(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Technologies with recipes, and the plant's links, of which each third has no third bus and each sixth no recipe."""
    name = F.concat_ws("_", "tech", F.col("variant").cast("string"))
    recipe = (F.col("component_type") == "link") & (F.col("variant") % 6 != 5)
    ins = F.create_map(F.lit("power"), 1 / F.col("eff") + F.col("variant") % 3, F.lit("water"), (F.col("variant") % 2 + 1) * 0.5)
    outs = F.create_map(F.lit("out"), F.lit(1.0), F.lit("heat"), F.lit(0.25))
    techs = v.select(name.alias("tech"), "component_type", "overnight", "lifetime", "rate", "om", F.when(F.col("variant") % 4 == 0, 0.01).alias("standing_loss"), F.when(recipe, ins).alias("carriers_in"), F.when(recipe, outs).alias("carriers_out"))
    third = F.when(F.col("variant") % 3 == 0, "water").when(F.col("variant") % 3 == 1, "heat")
    links = v.where("component_type = 'link'").select(name.alias("name"), F.lit("power").alias("bus0"), F.lit("out").alias("bus1"), third.alias("bus2"), F.col("eff").alias("efficiency"), F.lit(None).cast("double").alias("efficiency2"))
    return techs, links


@query("variants", f", r as (select *, tech||'_'||variant name, {_ANNUAL} annual, component_type='link' and variant%6<>5 recipe, 1e0/eff+variant%3 taken from variants), e as (select *, case when component_type='link' then case when recipe then 1e0/taken else eff end end efficiency, case when recipe and variant%3=0 then -(variant%2+1)*0.5e0/taken when recipe and variant%3=1 then 0.25e0/taken end efficiency2 from r) select name tech, component_type, round(efficiency,3) efficiency, round(efficiency2,3) efficiency2, case when component_type='store' and variant%4=0 then 0.01e0 end standing_loss, round(annual,3) annual_cost, round(annual*case when component_type='link' then efficiency when component_type='store' then 6e0 else 1e0 end,3) capital_cost, round(case when recipe then (1e0+greatest(coalesce(efficiency2,0e0),0e0)/efficiency)/(1e0/efficiency+greatest(-coalesce(efficiency2,0e0),0e0)/efficiency) end,3) overall_efficiency from e", digits=3)
def compiled_components(v: DataFrame) -> DataFrame:
    return costs.compile_costs(*_with_recipes(v), time_step=2.0, aggregation=3)


@query("variants", ", r as (select *, tech||'_'||variant name, 1e0/eff+variant%2*0.5e0 taken from variants where component_type='link') select name tech, 'amount in' problem, 'power' detail from r where variant%2=1 union all select name, 'extra in', 'water' from r where variant%5=0 union all select name, 'missing out', 'heat' from r where variant%7=0 union all select name, 'efficiency', 'overall_efficiency' from r where abs(eff-1e0/(taken+case when variant%5=0 then 1e0 else 0e0 end))>0.02e0")
def recipe_mismatches(v: DataFrame) -> DataFrame:
    v = v.where("component_type = 'link'").withColumn("name", F.concat_ws("_", "tech", F.col("variant").cast("string")))
    power = F.create_map(F.lit("power"), 1 / F.col("eff") + F.col("variant") % 2 * 0.5)
    ins = F.when(F.col("variant") % 5 == 0, F.map_concat(power, F.create_map(F.lit("water"), F.lit(1.0)))).otherwise(power)
    techs = v.select(F.col("name").alias("tech"), ins.alias("carriers_in"), F.create_map(F.lit("out"), F.lit(1.0)).alias("carriers_out"), F.col("eff").alias("overall_efficiency"))
    heat = F.col("variant") % 7 == 0
    links = v.select("name", F.lit("power").alias("bus0"), F.lit("out").alias("bus1"), F.when(heat, "heat").alias("bus2"), F.col("eff").alias("efficiency"), F.when(heat, 0.1).alias("efficiency2"))
    return costs.check_recipes(techs, links)


@query("variants", ", r as (select tech||'_'||variant name, eff, case variant%3 when 0 then -0.3e0 when 1 then 0.2e0 end e2 from variants where component_type='link') select name, round(1e0/eff,6) power_in, round(case when e2<0 then -e2/eff end,6) third_in, 1e0 out, round(case when e2>=0 then e2/eff end,6) third_out from r", digits=6)
def recipes_of_links(v: DataFrame) -> DataFrame:
    from .functions.recipes import recipe_per_output

    flow = F.when(F.col("variant") % 3 == 0, -0.3).when(F.col("variant") % 3 == 1, 0.2)
    third = F.when(flow.isNotNull(), "third")
    ins, outs = recipe_per_output(F.lit("power"), F.lit("out"), third, F.col("eff"), flow)
    of = lambda m, k: F.try_element_at(m, F.lit(k))
    name = F.concat_ws("_", "tech", F.col("variant").cast("string")).alias("name")
    return v.where("component_type = 'link'").select(name, of(ins, "power").alias("power_in"), of(ins, "third").alias("third_in"), of(outs, "out").alias("out"), of(outs, "third").alias("third_out"))


@query("parts", ", f as (select tech, case part when 'A' then 'electrical' when 'N' then 'process' else 'civil' end bucket, sum(cost*percent/100e0) cost from parts group by 1,2) select tech, bucket, round(cost,2) cost, round(cost*0.5e0,2) per_mw, round(cost*0.5e0,2) per_mwh from f", digits=2)
def derived_cost_split(parts: DataFrame) -> DataFrame:
    bucket = F.when(F.col("part") == "A", "electrical").when(F.col("part") == "N", "process").otherwise("civil")
    return costs.derive_cost_split(parts, parts.select("part", bucket.alias("bucket")).distinct())


@query("spatial", "select 'none' kind, 0 n, cast(null as double) rate union all select 'spatial', count(*), round(avg(interest_rate),6) from spatial union all select 'custom', count(*), round(avg(interest_rate),6) from spatial where tech='wind'", digits=6)
def override_sources(spatial: DataFrame) -> DataFrame:
    used = {kind: costs.override_source(kind, spatial, spatial.where("tech = 'wind'")) for kind in ("none", "spatial", "custom")}
    parts = [rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.avg("interest_rate").alias("rate")) for kind, rows in used.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _placed(spatial: DataFrame, cells: DataFrame, moved: Column) -> DataFrame:
    return spatial.join(cells.select("cell_id", "latitude", "longitude"), "cell_id").withColumn("latitude", F.col("latitude") + moved)


@query("cells spatial", ", p as (select s.*, c.latitude+(case when file_order%5=0 then 0.3e0 else file_order%3*0.00001e0 end) latitude, c.longitude from spatial s join cells c using (cell_id)), k as (select round(latitude,4) la, round(longitude,4) lo, tech, arg_max(interest_rate,file_order) filter (interest_rate is not null) interest_rate, arg_max(build_cost_multiplier,file_order) filter (build_cost_multiplier is not null) build_cost_multiplier from p group by 1,2,3) select c.cell_id, tech, round(interest_rate,6) interest_rate, round(build_cost_multiplier,6) build_cost_multiplier from cells c join k on la=round(c.latitude,4) and lo=round(c.longitude,4)", digits=6)
def overrides_by_place(cells: DataFrame, spatial: DataFrame) -> DataFrame:
    moved = F.when(F.col("file_order") % 5 == 0, 0.3).otherwise(F.col("file_order") % 3 * 0.00001)
    return costs.place_overrides(cells, _placed(spatial, cells, moved))


@query("variants", ", t as (select variant//15 scenario, tech, case when variant%4=0 then 0e0 else overnight/1e6 end land from variants where tech in ('solar','solar_tracking')) select scenario, round(arg_min(land, tech),6) land_use_km2_per_mw from t where land>0 group by 1", digits=6)
def land_use_bases(v: DataFrame) -> DataFrame:
    land_use = F.when(F.col("variant") % 4 == 0, 0.0).otherwise(F.col("overnight") / 1e6)
    return land.base_land_use(v.select(F.floor(F.col("variant") / 15).alias("scenario"), F.col("tech").alias("name"), land_use.alias("land_use_km2_per_mw")))


@query("spatial cells", f", t as ({_TECH_LAST}), b as (select t.*, bathymetry_depth_m d from t join cells using (cell_id) where onshore_land_pct=0), r as (select *, row_number() over (order by d, cell_id, tech) up, row_number() over (order by d desc, cell_id, tech) down from b) select cell_id, tech, round(d,4) bathymetry_depth_m, up<=5 shallow from r where up<=5 union all select cell_id, tech, round(d,4), false from r where down<=5")
def depth_ends(spatial: DataFrame, cells: DataFrame) -> DataFrame:
    ends = analysis.depth_ends(costs.tech_overrides(spatial), cells)
    middle = ends.agg(((F.min("bathymetry_depth_m") + F.max("bathymetry_depth_m")) / 2).alias("middle"))
    return ends.crossJoin(middle).select("cell_id", "tech", "bathymetry_depth_m", (F.col("bathymetry_depth_m") < F.col("middle")).alias("shallow"))


# --- lookups -------------------------------------------------------------------------------------------------------------


_SITES = "sites as (select cell_id, latitude+0.3e0 latitude, longitude-0.4e0 longitude from cells), points as (select distinct w.cell_id, c.latitude, c.longitude from weather w join cells c on c.cell_id=w.cell_id)"
_NEAR = f"{_SITES}, la as (select cell_id, arg_min(a, (abs(a-latitude), -a)) near_lat from sites, (select distinct latitude a from points) group by 1), lo as (select cell_id, arg_min(a, (abs(a-longitude), -a)) near_lon from sites, (select distinct longitude a from points) group by 1), near as (select cell_id, near_lat, near_lon from la join lo using (cell_id))"


def _beside(cells: DataFrame) -> DataFrame:
    """Sites beside the cells."""
    return cells.select("cell_id", (F.col("latitude") + 0.3).alias("latitude"), (F.col("longitude") - 0.4).alias("longitude"))


@query("weather cells", f", {_NEAR} select n.cell_id, near_lat, near_lon, resource, w.ts, round(cf,6) cf from near n join points p on p.latitude=near_lat and p.longitude=near_lon join weather w on w.cell_id=p.cell_id", digits=6)
def weather_of_sites(rows: DataFrame, cells: DataFrame) -> DataFrame:
    gridded = rows.join(cells.select("cell_id", "latitude", "longitude"), "cell_id").drop("cell_id")
    return weather.site_weather(_beside(cells), gridded).select("cell_id", "near_lat", "near_lon", "resource", "ts", "cf")


@query("weather cells", f"{_DENSE}, {_NEAR}, d as (select n.cell_id, d.hour_index, resource, cf from near n join points p on p.latitude=near_lat and p.longitude=near_lon join dense d on d.cell_id=p.cell_id) select cell_id, hour_index, round(max(cf) filter (resource='solar'),9) solar, round(max(cf) filter (resource='wind')*0.93e0,9) wind, round(coalesce(max(cf) filter (resource='solar_tracking'),max(cf) filter (resource='solar')),9) solar_tracking, 0e0 grid, 1e0 ramp_dummy from d group by 1,2", digits=9)
def frames_of_sites(rows: DataFrame, cells: DataFrame) -> DataFrame:
    return weather.location_frame(_beside(cells), rows, cells.select("cell_id", "latitude", "longitude"))


@query("cells", ", v as (select distinct latitude+0.5e0 v from cells), a as (select latitude l, min(cell_id) p from cells group by 1) select v, arg_min(l, (abs(l-v), p)) nearest from v, a group by 1")
def snapped_latitudes(cells: DataFrame) -> DataFrame:
    axis = cells.groupBy(F.col("latitude").alias("axis_value")).agg(F.min("cell_id").alias("position"))
    return lookup.nearest_on_axis(cells.select((F.col("latitude") + 0.5).alias("value")), axis, tie="first").select(F.col("value").alias("v"), "nearest")


@query("cells", "select cell_id, latitude, longitude from cells order by cell_id limit 25")
def first_places(cells: DataFrame) -> DataFrame:
    return lookup.first_rows(cells.select("cell_id", "latitude", "longitude"), ["cell_id"], 25)


@query(
    "cells edges",
    """, p as (select cell_id id, longitude x, latitude y from cells where abs(latitude)<=60 order by max_capacity_mw desc nulls last, cell_id limit 1),
 t as (select id, polygon_order, country, sum(case when (y1>y)<>(y2>y) and x<(x2-x1)*(y-y1)/(case when y2=y1 then 1e0 else y2-y1 end)+x1 then 1 else 0 end)%2=1
  or max(case when (x2-x1)*(y-y1)=(y2-y1)*(x-x1) and x between least(x1,x2) and greatest(x1,x2) and y between least(y1,y2) and greatest(y1,y2) then 1 else 0 end)=1 as inside from p, edges group by 1,2,3)
 select p.id, arg_min(t.country, t.polygon_order) country from p left join t on t.id=p.id and t.inside group by 1""",
)
def country_of_largest_site(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """One point against all polygons, with their holes."""
    one = cells.where("abs(latitude) <= 60").orderBy(F.col("max_capacity_mw").desc_nulls_last(), "cell_id").limit(1)
    return lookup.locate_country(one.select(F.col("cell_id").alias("id"), F.col("longitude").alias("x"), F.col("latitude").alias("y")), edges)


# --- series --------------------------------------------------------------------------------------------------------------


@query("weather", f"{_DENSE} select cell_id, resource, hour_index, round(cf,6) cf from dense where hour_index < 24", digits=6)
def first_day(rows: DataFrame) -> DataFrame:
    return weather.first_hours(weather.dense_hours(rows), 24).select("cell_id", "resource", "hour_index", "cf")


@query("weather", f"{_DENSE}, m as (select cell_id, resource, cast(hour_index//6 as int) block, avg(cf) cf from dense group by 1,2,3) select cell_id, resource, block, round(case when avg(cf) over (partition by cell_id, resource)<=0 then 0e0 else cf end,6) cf from m", digits=6)
def strict_block_mean(rows: DataFrame) -> DataFrame:
    return weather.block_mean_strict(weather.dense_hours(rows), 6)


# --- detailed results ----------------------------------------------------------------------------------------------------

_LINKS = "links as (select tech name, 'AC_'||tech carrier, 'power' bus0, case when eff<1 then 'water' end bus2, eff efficiency from techs where component_type='link')"


def links_of(techs: DataFrame) -> DataFrame:
    return techs.where("component_type = 'link'").select(F.col("tech").alias("name"), F.concat(F.lit("AC_"), "tech").alias("carrier"), F.lit("power").alias("bus0"), F.when(F.col("eff") < 1, "water").alias("bus2"), F.col("eff").alias("efficiency"))


@query("capacity techs", f", {_LINKS} select c.cell_id, c.name, round(optimum*efficiency*0.5e0,4) rated_mw, carrier, bus0 primary_source, bus2 secondary_source from capacity c join links using (name)")
def rated_components(capacity: DataFrame, techs: DataFrame) -> DataFrame:
    return results.rated_components(capacity, links_of(techs), 0.5)


@query("capacity techs", "select cell_id, name, round(optimum*0.5e0*0.8e0,4) storage_mwh from capacity where name in (select tech from techs where component_type='store')")
def scaled_stores(capacity: DataFrame, techs: DataFrame) -> DataFrame:
    return results.scaled_stores(capacity, techs.where("component_type = 'store'").select(F.col("tech").alias("name")), 0.5, 0.8)


_FLOWS = "['electrolysis','hydrogen_compression','hydrogen_from_storage','battery_pcs_charge','battery_pcs_discharge','hydrogen_fuel_cell','ammonia_synthesis']"
_SUMS = "sum(p*0.5e0) filter (flow='{}')"


def flows_of(dispatch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dispatch dealt over the flows of a plant, primary by the hour, secondary by the half of the day."""
    names = F.array(*(F.lit(n) for n in ("electrolysis", "hydrogen_compression", "hydrogen_from_storage", "battery_pcs_charge", "battery_pcs_discharge", "hydrogen_fuel_cell", "ammonia_synthesis")))
    day = F.date_trunc("day", "ts").alias("ts")
    first = dispatch.select("cell_id", day, F.get(names, F.hour("ts") % 7).alias("name"), "p")
    second = dispatch.select("cell_id", day, F.when(F.hour("ts") < 12, "hydrogen_compression").otherwise("ammonia_synthesis").alias("name"), "p")
    return first, second


_PRIMARY = (("electrolysis", "", "electrolysis_mw"), ("hydrogen_compression", "/39.4e0", "hydrogen_to_storage_t_per_h"), ("hydrogen_from_storage", "/39.4e0", "hydrogen_from_storage_t_per_h"), ("battery_pcs_charge", "", "battery_charge_mw"), ("battery_pcs_discharge", "", "battery_discharge_mw"), ("hydrogen_fuel_cell", "*0.5e0", "fuel_cell_mw"), ("ammonia_synthesis", "", "synthesis_power_mw"))
_CONSUMED = (
    "first_flows as (select cell_id, date_trunc('day',ts)::timestamp ts, " + _FLOWS + "[1+extract(hour from ts)::int%7] flow, p from dispatch), second_flows as (select cell_id, date_trunc('day',ts)::timestamp ts, case when extract(hour from ts)<12 then 'hydrogen_compression' else 'ammonia_synthesis' end flow, p from dispatch),"
    " primary_sums as (select cell_id, ts, " + ", ".join(f"{_SUMS.format(n)}{d} {c}" for n, d, c in _PRIMARY) + " from first_flows group by 1,2),"
    " secondary_sums as (select cell_id, ts, " + _SUMS.format("hydrogen_compression") + " compression_power_mw, " + _SUMS.format("ammonia_synthesis") + "/39.4e0 synthesis_hydrogen_t_per_h from second_flows group by 1,2),"
    " consumed as (select *, synthesis_hydrogen_t_per_h/0.18e0 ammonia_t_per_h from primary_sums join secondary_sums using (cell_id, ts))"
)


@query("dispatch", f", {_CONSUMED} select cell_id, ts, round(columns(* exclude (cell_id, ts)),4) from consumed")
def daily_consumption(dispatch: DataFrame) -> DataFrame:
    return results.consumption(*flows_of(dispatch), 0.5, 0.5)


@query("dispatch techs", "select cell_id, ts, round(sum(p) filter (name='solar')*0.5e0,4) solar, round(sum(p) filter (name='wind')*0.5e0,4) wind from dispatch where name in (select tech from techs where component_type='generator') group by 1,2")
def generation(dispatch: DataFrame, techs: DataFrame) -> DataFrame:
    return results.generation(dispatch, techs.where("component_type = 'generator'").select(F.col("tech").alias("name")), 0.5)


@query("levels", "select cell_id, ts, round(sum(e) filter (name='ammonia')*3e0,4) ammonia, round(sum(e) filter (name='battery_storage')*3e0,4) battery_storage, round(sum(e) filter (name='compressed_hydrogen_store')*3e0,4) compressed_hydrogen_store from levels group by 1,2")
def stored_energy(levels: DataFrame) -> DataFrame:
    return results.stored_energy(levels, scale=0.5, aggregation=3, time_step=2.0)


@query("dispatch", ", a as (select cell_id, ts, sum(p) filter (name='wind') wind, sum(p) filter (name='solar') solar, -sum(p) filter (name='ammonia_synthesis') ammonia_synthesis from dispatch group by 1,2) select cell_id, ts, round(wind*2.5e0,4) wind, round(solar*2.5e0,4) solar, round(ammonia_synthesis*2.5e0,4) ammonia_synthesis from a")
def rescaled_timeline(dispatch: DataFrame) -> DataFrame:
    return results.rescale(results.timeline(dispatch), ["wind", "solar", "ammonia_synthesis"], 2.5)


@query("capacity results", ", w as (select cell_id, sum(optimum) filter (name='wind') wind, sum(optimum) filter (name='solar') solar from capacity group by 1) select round(r.lcoa_per_t,6) lcoa_per_t, null::double annual_ammonia_production_t, null::double total_cost, round(wind,6) wind, round(solar,6) solar, null::double electrolysis, null::double ammonia_synthesis, null::double hydrogen_storage_capacity, round(grid_energy_mwh,6) grid_energy_mwh from results r join w on w.cell_id=r.row_no", digits=6)
def site_headlines(capacity: DataFrame, rows: DataFrame) -> DataFrame:
    sizes = capacity.groupBy("cell_id").agg(*(F.sum(F.when(F.col("name") == n, F.col("optimum"))).alias(n) for n in ("wind", "solar")))
    return results.site_headline(rows.withColumnRenamed("lcoa_per_t", "lcoa_usd_per_t").join(sizes, F.col("row_no") == F.col("cell_id")))


@query("results", "select row_no, upper('eur') currency, round(case row_no%3 when 0 then lcoa_per_t when 1 then lcoa_per_t*2e0 else lcoa_per_t*3e0 end,6) lcoa_per_t from results", digits=6)
def backfilled_currency(rows: DataFrame) -> DataFrame:
    of = lambda k, f: F.when(F.col("row_no") % 3 == k, F.col("lcoa_per_t") * f)
    old = rows.select("row_no", of(0, 1.0).alias("lcoa_eur_per_t"), of(1, 2.0).alias("lcoa_currency_per_t"), F.coalesce(of(2, 3.0), F.lit(-1.0)).alias("lcoa_usd_per_t"))
    return results.backfill_currency(old, " Eur ").select("row_no", "currency", "lcoa_per_t")


@query("results", "select row_no, round(lcoa_per_t*0.9e0,6) shown from results", digits=6)
def shown_metric(rows: DataFrame) -> DataFrame:
    both = rows.select("row_no", F.lit(" EUR").alias("currency"), F.col("lcoa_per_t").alias("lcoa_usd_per_t"), (F.col("lcoa_per_t") * 0.9).alias("lcoa_eur_per_t"))
    return both.select("row_no", F.col(metric_column(both)).alias("shown"))


@query("capacity", "select cell_id, round(sum(optimum) filter (name='wind'),4) wind_mw, round(sum(optimum) filter (name='electrolysis'),4) electrolysis_mw, round(sum(optimum) filter (name='compressed_hydrogen_store'),4) compressed_hydrogen_store_mwh, count(*)::double hydrogen_storage_capacity_t, 50e0 land_onshore_pct from capacity group by 1")
def columns_with_units(capacity: DataFrame) -> DataFrame:
    sums = [F.sum(F.when(F.col("name") == n, F.col("optimum"))).alias(n) for n in ("wind", "electrolysis", "compressed_hydrogen_store")]
    return with_units(capacity.groupBy("cell_id").agg(*sums, F.count("*").cast("double").alias("hydrogen_storage_capacity"), F.lit(50.0).alias("percent_onshore")))


_WIDE = ("other", "interest_rate_wind", "cost_share_wind_pct", "wind_mw", "hydrogen_storage_capacity_t", "lcoa_component_wind_per_t", "land_used_km2", "bathymetry_depth_m", "lcoa_per_t", "currency", "country", "longitude", "latitude")
_ORDERED = ("latitude", "longitude", "country", "currency", "lcoa_per_t", "bathymetry_depth_m", "land_used_km2", "wind_mw", "hydrogen_storage_capacity_t", "cost_share_wind_pct", "lcoa_component_wind_per_t", "interest_rate_wind", "other")


@query("results", "select unnest([" + ",".join(f"'{c}'" for c in _ORDERED) + f"]) \"column\", unnest(range({len(_ORDERED)}))::int place, count(*) rows, round(sum(lcoa_per_t),2) lcoa from results", digits=2)
def ordered_columns(rows: DataFrame) -> DataFrame:
    """Each column of a result in report order with its place, and totals of the rows."""
    extra = [F.lit(float(k)).alias(c) for k, c in enumerate(_WIDE) if c not in rows.columns]
    ordered = results.order_columns(rows.select(*rows.columns, *extra).select(*_WIDE))
    totals = ordered.agg(F.count("*").alias("rows"), F.sum("lcoa_per_t").alias("lcoa"))
    return totals.select(F.posexplode(F.lit(ordered.columns)).alias("place", "column"), "rows", "lcoa")


@query("cells results weather", "select 'cells' \"table\", '' missing, count(*) rows from cells union all select 'results', 'currency', count(*) from results union all select 'weather', 'latitude, longitude', count(*) from weather")
def preflight_report(cells: DataFrame, rows: DataFrame, series: DataFrame) -> DataFrame:
    """Seen while a run writes its inputs, by the scans of that run."""
    spark, check = cells.sparkSession, results.Preflight()
    for name, df, needed in (("cells", cells, ("latitude", "longitude")), ("results", rows, ("latitude", "currency")), ("weather", series, ("latitude", "longitude", "cf"))):
        check.watch(name, df, needed).write.parquet(new_path(spark, name))
    return check.report(spark).select("table", "missing", "rows")


@query("spatial cells", "select distinct 'AC_'||cell_id carrier from (select cell_id from spatial union all select cell_id from cells where max_capacity_mw>0) where cell_id not in (select cell_id from cells where onshore_land_pct=0)")
def missing_carriers(spatial: DataFrame, cells: DataFrame) -> DataFrame:
    carrier = F.concat(F.lit("AC_"), F.col("cell_id").cast("string"))
    named = [spatial.select(carrier.alias("carrier")), cells.where("max_capacity_mw > 0").select(carrier.alias("carrier"))]
    return checks.missing_carriers(named, cells.where("onshore_land_pct = 0").select(carrier.alias("name")))
