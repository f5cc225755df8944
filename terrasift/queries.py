"""Registered queries over inputs derived from the driver's tables, and the SQL that gives the same rows.

Doubles are rounded in both, as engines add them up in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.costs import annual_cost, capital_recovery, legacy_annual_cost
from .functions.geometry import cell_area_km2, cell_id, solar_density
from .functions.names import location_label, normalize_name
from .functions.recipes import differing_keys, extra_keys, float_map, overall_efficiency
from .operators import analysis, checks, costs, economics, land, lookup, results, sizing, weather
from .registry import ORACLES, QUERIES, query
from .schemas import COST_COMPONENTS
from .sources import sinks, tables

# --- results -----------------------------------------------------------------------------------------------------------

_LAST = ", last as (select * exclude (turn) from (select *, row_number() over (partition by latitude, longitude order by file_rank desc, row_no desc) turn from results) where turn = 1)"


@query("results", f"{_LAST}, ranked as (select latitude, longitude, country, round(lcoa_per_t,6) lcoa_per_t, row_number() over (order by lcoa_per_t, latitude, longitude) rank from last where lcoa_per_t <= 2000) select rank, latitude, longitude, country, lcoa_per_t from ranked where rank <= 20", digits=6)
def cheapest_sites(rows: DataFrame) -> DataFrame:
    return analysis.cheapest(analysis.clipped(results.combine_segments(rows))).select("rank", "latitude", "longitude", "country", "lcoa_per_t")


@query("results", f"{_LAST} select country, count(lcoa_per_t) sites, round(median(lcoa_per_t),9) median_lcoa, round(min(lcoa_per_t),9) min_lcoa, round(max(lcoa_per_t),9) max_lcoa from last where country is not null group by country", digits=9)
def country_lcoa_stats(rows: DataFrame) -> DataFrame:
    return analysis.country_stats(results.combine_segments(rows))


@query("results", f"{_LAST} select latitude, longitude, country, round(lcoa_per_t,6) lcoa_per_t, grid_energy_mwh, file_rank, row_no from last", digits=6)
def combine_segments_last(rows: DataFrame) -> DataFrame:
    return results.combine_segments(rows)


@query("results", "select count(lcoa_per_t) count, round(avg(lcoa_per_t),9) mean, round(stddev_samp(lcoa_per_t),9) std, round(min(lcoa_per_t),9) min, round(quantile_cont(lcoa_per_t,0.25),9) p25, round(quantile_cont(lcoa_per_t,0.5),9) p50, round(quantile_cont(lcoa_per_t,0.75),9) p75, round(quantile_cont(lcoa_per_t,0.9),9) p90, round(quantile_cont(lcoa_per_t,0.99),9) p99, round(max(lcoa_per_t),9) max from results", digits=9)
def lcoa_describe(rows: DataFrame) -> DataFrame:
    return analysis.describe(rows, "lcoa_per_t")


@query("results", "select round(quantile_cont(lcoa_per_t,0.02),9) low, round(quantile_cont(lcoa_per_t,0.98),9) high from results", digits=9)
def lcoa_clip_quantiles(rows: DataFrame) -> DataFrame:
    return analysis.clip_quantiles(rows)


_BINS = "ends as (select min({c}) least, max({c}) most from {t}), placed as (select least, most, least(cast({n} as bigint), cast(floor(({c}-least)/((most-least)/{n})) as bigint)+1) bin from {t}, ends where {c} is not null) select cast(bin as int) bin, round(least+(bin-1)*((most-least)/{n}),4) low, round(least+bin*((most-least)/{n}),4) high, count(*) rows from placed group by bin, least, most"


@query("results", ", " + _BINS.format(c="lcoa_per_t", t="results", n=80))
def lcoa_histogram(rows: DataFrame) -> DataFrame:
    return analysis.histogram(rows, "lcoa_per_t", 80)


@query("cells", ", " + _BINS.format(c="max_capacity_mw", t="cells", n=60))
def capacity_histogram(cells: DataFrame) -> DataFrame:
    return analysis.histogram(cells, "max_capacity_mw", 60)


@query("cells results", ", land as (select distinct latitude, longitude from cells where max_capacity_mw > 0), solved as (select latitude, longitude, any_value(country) country, true solved from results group by 1,2), f as (select l.*, country, solved from land l left join solved s using (latitude, longitude)) select count(*) land_cells, count(solved) solved, count(country) with_country, count(*)-count(solved) missing, count(solved)-count(country) without_country, round(count(solved)*100e0/count(*),4) solved_pct from f")
def coverage_report(cells: DataFrame, rows: DataFrame) -> DataFrame:
    return analysis.coverage(cells, rows)


@query("results", 'select * from (select \'country\' "column", count(*) filter (country is null) nulls from results union all select \'lcoa_per_t\', count(*) filter (lcoa_per_t is null) from results union all select \'grid_energy_mwh\', count(*) filter (grid_energy_mwh is null) from results) where nulls > 0')
def null_counts(rows: DataFrame) -> DataFrame:
    return analysis.null_counts(rows)


@query("results", "select count(*) rows, count(*) filter (lcoa_per_t > 2000) above_clip, count(*) filter (grid_energy_mwh >= 1000) on_backstop, count(*) filter (grid_energy_mwh >= 1000 and lcoa_per_t <= 2000) on_backstop_inside from results")
def clip_and_backstop(rows: DataFrame) -> DataFrame:
    return analysis.clip_report(rows)


@query("results", "select country, count(*) rows from results where country is not null group by 1 order by 2 desc, 1 limit 20")
def frequent_countries(rows: DataFrame) -> DataFrame:
    return analysis.most_frequent(rows)


_TOP = ", top as (select country from results where country is not null group by 1 order by count(*) desc, 1 limit 20)"


@query("results", f"{_TOP}, q as (select country, quantile_cont(lcoa_per_t,0.25) q1, quantile_cont(lcoa_per_t,0.5) median, quantile_cont(lcoa_per_t,0.75) q3 from results where country in (select country from top) group by 1) select country, round(q1,9) q1, round(median,9) median, round(q3,9) q3, round(min(lcoa_per_t),9) low, round(max(lcoa_per_t),9) high from q join results using (country) where lcoa_per_t between q1-1.5e0*(q3-q1) and q3+1.5e0*(q3-q1) group by country, q1, median, q3", digits=9)
def country_box_stats(rows: DataFrame) -> DataFrame:
    return analysis.box_stats(analysis.of_top_countries(rows), "country")


@query("results", "select count(distinct country) country, count(distinct file_rank) file_rank, count(distinct row_no) row_no from results")
def distinct_counts(rows: DataFrame) -> DataFrame:
    return analysis.distinct_counts(rows, "country", "file_rank", "row_no")


@query("results", "select round(min(latitude)-0.6e0,4) min_latitude, round(max(latitude)+0.6e0,4) max_latitude, round(min(longitude)-0.6e0,4) min_longitude, round(max(longitude)+0.6e0,4) max_longitude from results")
def map_extent(rows: DataFrame) -> DataFrame:
    return analysis.extent(rows)


@query("cells results", "select distinct latitude, longitude from cells where max_capacity_mw > 0 and (latitude, longitude) not in (select (latitude, longitude) from results where lcoa_per_t <= 2000)")
def retry_list(cells: DataFrame, rows: DataFrame) -> DataFrame:
    return results.retry_list(cells.where("max_capacity_mw > 0"), analysis.clipped(rows))


@query(
    "results",
    f"{_LAST}, q as (select quantile_cont(lcoa_per_t,0.02) low, quantile_cont(lcoa_per_t,0.98) high from last) select format('{{:.2f}}_{{:.2f}}', latitude, longitude) cell, "
    "'{\"type\":\"Polygon\",\"coordinates\":[[['||w||','||s||'],['||e||','||s||'],['||e||','||n||'],['||w||','||n||'],['||w||','||s||']]]}' geojson, round(greatest(low,least(high,lcoa_per_t)),6) \"value\", round(low,6) low, round(high,6) high "
    "from (select *, longitude-0.5e0 w, longitude+0.5e0 e, latitude-0.5e0 s, latitude+0.5e0 n from last), q where lcoa_per_t is not null",
    digits=6,
)
def cell_geojson_feed(rows: DataFrame) -> DataFrame:
    return analysis.map_feed(results.combine_segments(rows))


@query("results", f"{_LAST} select cast(round_even(latitude-(select min(latitude) from last),0) as int) \"row\", cast(round_even(longitude-(select min(longitude) from last),0) as int) col, round(lcoa_per_t,6) \"value\" from last", digits=6)
def cost_raster(rows: DataFrame) -> DataFrame:
    return analysis.raster(results.combine_segments(rows), F.col("lcoa_per_t"))


@query("results", f"{_LAST} select latitude, longitude, round(grid_energy_mwh,6) x, round(lcoa_per_t,6) y from last where grid_energy_mwh is not null and lcoa_per_t is not null", digits=6)
def backstop_scatter(rows: DataFrame) -> DataFrame:
    return analysis.scatter_feed(results.combine_segments(rows), "grid_energy_mwh", "lcoa_per_t")


@query("results", f"{_LAST} select format('lat{{:.2f}}_lon{{:.2f}}', latitude, longitude) tag, metric, \"value\" from (select latitude, longitude, unnest(['country','file_rank','row_no']) metric, unnest([country, file_rank::varchar, row_no::varchar]) \"value\" from last)")
def result_key_values(rows: DataFrame) -> DataFrame:
    last = results.combine_segments(rows).select("latitude", "longitude", "country", "file_rank", "row_no")
    return sinks.key_values(last)


@query("results", f"{_LAST} select format('{{:.2f}}_{{:.2f}}', latitude, longitude) cell, coalesce(country,'Ocean/Unclaimed') || ' (' || format('{{:.1f}}, {{:.1f}}', latitude, longitude) || ')' label from last")
def site_labels(rows: DataFrame) -> DataFrame:
    last = results.combine_segments(rows)
    return last.select(cell_id(F.col("latitude"), F.col("longitude")).alias("cell"), location_label(F.col("country"), F.col("latitude"), F.col("longitude")).alias("label"))


# --- costs -------------------------------------------------------------------------------------------------------------

_CRF = "case when abs({r})<1e-12 then 1e0/{n} else {r}*pow(1e0+{r},{n})/(pow(1e0+{r},{n})-1e0) end"


@query("variants", f"select variant, tech, round({_CRF.format(r='rate', n='lifetime')},4) crf, round(overnight*({_CRF.format(r='rate', n='lifetime')}+om),4) annual from variants", digits=4)
def annuity_costs(v: DataFrame) -> DataFrame:
    years, rate = F.col("lifetime"), F.col("rate")
    return v.select("variant", "tech", capital_recovery(rate, years).alias("crf"), annual_cost(F.col("overnight"), rate, years, F.col("om")).alias("annual"))


@query("variants", f"select variant, tech, component_type, round(overnight*({_CRF.format(r='rate', n='lifetime')}+om)*case component_type when 'link' then eff when 'store' then 2e0 else 1e0 end,4) capital_cost from variants")
def compiled_plant_costs(v: DataFrame) -> DataFrame:
    return costs.base_costs(v, time_step=2.0).select("variant", "tech", "component_type", "capital_cost")


@query("variants", "select tech, round(tech_cost+build_cost-overnight*case when variant%50=0 then 2e0 else 1e0 end,4) gap from variants where abs(tech_cost+build_cost-overnight*case when variant%50=0 then 2e0 else 1e0 end) > 1e-3")
def cost_split_check(v: DataFrame) -> DataFrame:
    return costs.check_cost_split(v.withColumn("overnight", F.col("overnight") * F.when(F.col("variant") % 50 == 0, 2.0).otherwise(1.0)), 1e-3)


@query("variants", ", m as (select variant, tech, eff, 1e0/eff a, case when variant%4=0 then 1.5e0/eff else 1e0/eff end b, variant%3=0 extra from variants where component_type='link') select variant, tech, case when extra then 'water' else '' end extra, case when abs(a-b) > 1e-3*greatest(1e0,abs(a)) then 'power' else '' end differing, round(1e0/(a+case when extra then 1e0 else 0e0 end),4) overall from m")
def recipe_check(v: DataFrame) -> DataFrame:
    need = 1 / F.col("eff")
    water = F.when(F.col("variant") % 3 == 0, 1.0)
    recipe = float_map(F.create_map(F.lit("power"), need, F.lit("water"), water))
    plant = F.create_map(F.lit("power"), F.when(F.col("variant") % 4 == 0, 1.5 * need).otherwise(need))
    outs = F.create_map(F.lit("product"), F.lit(1.0))
    return v.where("component_type = 'link'").select("variant", "tech", F.array_join(extra_keys(recipe, plant), ",").alias("extra"), F.array_join(differing_keys(plant, recipe), ",").alias("differing"), overall_efficiency(recipe, outs).alias("overall"))


_DEPTH = "case when not coalesce(depth>0,false) then 1e0 when tech='wind' then case when depth<=60 then 1.3e0+depth/60*0.5e0 when depth<=300 then 1.8e0+(depth-60)/240*0.7e0 when depth<=1500 then 2.5e0+(depth-300)/1200*1e0 else 3.5e0 end else case when depth<=60 then 1.1e0+depth/60*0.2e0 when depth<=300 then 1.3e0+(depth-60)/240*0.5e0 when depth<=1500 then 1.8e0+(depth-300)/1200*0.7e0 else 2.5e0 end end"


@query("cells techs", f"select cell_id, latitude lat, longitude lon, tech, rate interest_rate, round(round_even({_DEPTH},4),4) build_cost_multiplier from (select *, case when onshore_land_pct=0 then abs(bathymetry_depth_m) else 0e0 end depth from cells, techs where max_capacity_mw>0)", digits=4)
def spatial_costs(cells: DataFrame, techs: DataFrame) -> DataFrame:
    return costs.build_spatial_costs(cells, techs)


_TECH_LAST = "select cell_id, tech, arg_max(interest_rate, file_order) filter (interest_rate is not null) interest_rate, arg_max(build_cost_multiplier, file_order) filter (build_cost_multiplier is not null) build_cost_multiplier from spatial group by 1,2"
_CELL_LAST = "select cell_id, arg_max(land_cost_usd_per_km2_year, file_order) filter (land_cost_usd_per_km2_year is not null) land_cost_usd_per_km2_year, arg_max(water_cost_usd_per_m3, file_order) filter (water_cost_usd_per_m3 is not null) water_cost_usd_per_m3 from spatial group by 1"


@query("spatial", f", t as ({_TECH_LAST}) select cell_id, tech, round(interest_rate,6) interest_rate, round(build_cost_multiplier,6) build_cost_multiplier from t", digits=6)
def override_consolidation(spatial: DataFrame) -> DataFrame:
    return costs.tech_overrides(spatial)


@query("spatial", f", l as ({_CELL_LAST}) select cell_id, round(land_cost_usd_per_km2_year,6) land_cost_usd_per_km2_year, round(water_cost_usd_per_m3,6) water_cost_usd_per_m3 from l", digits=6)
def location_override_consolidation(spatial: DataFrame) -> DataFrame:
    return costs.location_overrides(spatial)


@query("spatial techs", f", t as ({_TECH_LAST}), b as (select cell_id, tech, interest_rate, (tech_cost+build_cost*coalesce(build_cost_multiplier,1e0))*({_CRF.format(r='interest_rate', n='lifetime')}+om)*case component_type when 'link' then eff else 1e0 end capital_cost from t join techs using (tech) where interest_rate is not null) select cell_id, tech, round(interest_rate,4) interest_rate, round(capital_cost,4) capital_cost from b")
def overridden_costs(spatial: DataFrame, techs: DataFrame) -> DataFrame:
    return costs.apply_overrides(techs, costs.tech_overrides(spatial))


@query("spatial cells", f", l as ({_CELL_LAST}) select cell_id, round(land_cost_usd_per_km2_year,4) land_cost_usd_per_km2_year, round(coalesce(water_cost_usd_per_m3,0.8e0),4) water_cost_usd_per_m3, 1.5e0 water_usage_m3_per_t_nh3, round(coalesce(water_cost_usd_per_m3,0.8e0)*1.5e0,4) water_cost_per_t from cells left join l using (cell_id)")
def resolved_location_costs(spatial: DataFrame, cells: DataFrame) -> DataFrame:
    meta = cells.sparkSession.createDataFrame([(None, 0.8)], "water_usage_m3_per_t_nh3 double, water_cost_baseline_usd_per_m3 double").coalesce(1)
    return costs.location_costs(cells.select("cell_id"), costs.location_overrides(spatial), meta)


@query("spatial", f", t as ({_TECH_LAST}) select cell_id, round(max(interest_rate) filter (tech='wind'),6) interest_rate_wind, round(max(interest_rate) filter (tech='solar'),6) interest_rate_solar, round(max(interest_rate) filter (tech='electrolysis'),6) interest_rate_electrolyser, round(max(interest_rate) filter (tech='battery_storage'),6) interest_rate_battery_storage from t where interest_rate is not null group by 1", digits=6)
def cell_interest_rates(spatial: DataFrame) -> DataFrame:
    return costs.interest_rates(costs.tech_overrides(spatial))


@query("spatial cells", ", r as (select min(water_cost_usd_per_m3) min_water_cost_usd_per_m3, max(water_cost_usd_per_m3) max_water_cost_usd_per_m3, min(build_cost_multiplier) min_build_cost_multiplier, max(build_cost_multiplier) max_build_cost_multiplier, min(land_cost_usd_per_km2_year) min_land_cost_usd_per_km2_year, max(land_cost_usd_per_km2_year) max_land_cost_usd_per_km2_year, count(distinct tech) techs from spatial) select round(columns(* exclude (techs)),4), techs, (select count(*) from cells where onshore_land_pct>0) onshore, (select count(*) from cells where onshore_land_pct=0) offshore from r")
def spatial_cost_ranges(spatial: DataFrame, cells: DataFrame) -> DataFrame:
    return analysis.cost_ranges(spatial, cells)


@query("cells techs", f", d as (select *, case when onshore_land_pct=0 then abs(bathymetry_depth_m) else 0e0 end depth from cells, techs where max_capacity_mw>0), m as (select tech, onshore_land_pct=0 offshore, round_even({_DEPTH},4) m from d) select tech, offshore, count(*) rows, round(avg(m),3) mean, round(min(m),3) min, round(max(m),3) max from m group by 1,2", digits=3)
def offshore_split(cells: DataFrame, techs: DataFrame) -> DataFrame:
    return analysis.offshore_multipliers(costs.build_spatial_costs(cells, techs), cells)


# --- land --------------------------------------------------------------------------------------------------------------

_FRACTIONS = ", f as (select cast(90-ceil(y_index/20e0) as double) latitude, cast(floor(x_index/20e0)-180 as double) longitude, modis_class, avg(percentage/100e0) fraction from landcover group by 1,2,3 having latitude between -75 and 75), av as (select latitude, longitude, least(greatest(sum(fraction*case modis_class when 0 then 1e0 when 6 then .5e0 when 7 then .5e0 when 8 then .15e0 when 9 then .2e0 when 10 then .2e0 when 16 then 1e0 else 0e0 end),0e0),1e0) wind_availability, 1e0-least(greatest(coalesce(sum(fraction) filter (modis_class=0),0e0),0e0),1e0) solar_availability from f group by 1,2)"
_AREA = "40589641e0*radians(1e0)*abs(sin(radians(latitude+1e0))-sin(radians(latitude)))"
_SOLAR = "1e6/((1.21e0*2.06e0/(0.45e0/1000e0))/least(greatest(1.21e0/greatest(2.06e0*(sin(tilt)+cos(tilt)/tan(alt)),2.06e0),0.05e0),0.8e0))"
_ANGLES = "radians(least(greatest(abs(latitude),15e0),55e0)) tilt, radians(least(greatest(90e0-abs(latitude)-23.44e0,5e0),89e0)) alt"


@query("landcover", f"{_FRACTIONS} select latitude, longitude, round(wind_availability,6) wind_availability, round(solar_availability,6) solar_availability, round(least(greatest(solar_availability*100e0,0e0),100e0),6) onshore_land_pct, round(greatest(wind_availability,solar_availability),6) availability from av", digits=6)
def land_aggregate(landcover: DataFrame) -> DataFrame:
    return land.availability(land.class_fractions(landcover))


@query("cells", f", a as (select *, {_ANGLES} from cells) select cell_id, round({_AREA},4) area, round({_SOLAR},4) density, round({_SOLAR}*(1e0/0.02e0)/(with z as (select radians(15e0) tilt, radians(90e0-23.44e0) alt) select {_SOLAR} from z),4) recalibrated from a")
def cell_area_density(cells: DataFrame) -> DataFrame:
    lat = F.col("latitude")
    return cells.select("cell_id", cell_area_km2(lat).alias("area"), solar_density(lat).alias("density"), solar_density(lat, km2_per_mw=0.02).alias("recalibrated"))


@query(
    "landcover bathymetry",
    f"""{_FRACTIONS}, lats as (select distinct a.latitude, arg_min(b.latitude, struct_pack(d:=abs(a.latitude-b.latitude), l:=b.latitude)) near from av a, (select distinct latitude from bathymetry) b group by 1),
 lons as (select distinct a.longitude, arg_min(b.longitude, struct_pack(d:=abs(a.longitude-b.longitude), l:=b.longitude)) near from av a, (select distinct longitude from bathymetry) b group by 1),
 c as (select av.*, depth_m, least(greatest(solar_availability*100e0,0e0),100e0) onshore_land_pct, {_AREA} area, {_ANGLES} from av join lats using (latitude) join lons using (longitude) left join bathymetry b on b.latitude=lats.near and b.longitude=lons.near),
 d as (select *, least(greatest(100e0-onshore_land_pct,0e0),100e0) offshore_sea_pct, {_SOLAR} sd from c), e as (select *, area*onshore_land_pct/100e0 onshore_area_km2, area*offshore_sea_pct/100e0 offshore_area_km2 from d), g as (select *, greatest(onshore_area_km2*sd,0e0) ps, greatest((onshore_area_km2+offshore_area_km2)*5e0,0e0) pw from e)
 select round(latitude,4) latitude, round(longitude,4) longitude, case when ps+pw>0 then 1e0 else 0e0 end availability, round(area,4) area, round(onshore_land_pct,4) onshore_land_pct, round(offshore_sea_pct,4) offshore_sea_pct, round(onshore_area_km2,4) onshore_area_km2, round(offshore_area_km2,4) offshore_area_km2, round(depth_m,4) bathymetry_depth_m, round(wind_availability,4) wind_availability, round(solar_availability,4) solar_availability, round(onshore_area_km2,4) solar_area_km2, round(onshore_area_km2+offshore_area_km2,4) wind_area_km2, 5e0 wind_density_mw_per_km2, round(sd,4) solar_density_mw_per_km2, round(ps,4) max_power_solar_mw, round(pw,4) max_power_wind_mw, round(ps+pw,4) max_capacity_mw, round(ps,4) solar_max_capacity, round(pw,4) wind_max_capacity, round(ps+pw,4) max_capacity from g""",
)
def cells_table(landcover: DataFrame, bathymetry: DataFrame) -> DataFrame:
    return land.build_cells(landcover, bathymetry)


@query("cells", "select cell_id, latitude, longitude, round(max_capacity_mw,4) max_capacity_mw from cells order by cells.max_capacity_mw desc, latitude, longitude limit 10")
def top_capacity_cells(cells: DataFrame) -> DataFrame:
    return analysis.largest(cells).select("cell_id", "latitude", "longitude", "max_capacity_mw")


@query("cells", "select case when onshore_land_pct=0 then 'ocean' when onshore_land_pct<100 then 'coastal' else 'land' end cell_class, count(*) cells from cells group by 1")
def cell_class_counts(cells: DataFrame) -> DataFrame:
    return land.cell_classes(cells)


@query("cells", "select latitude lat, longitude lon from cells where max_capacity_mw>0 and longitude>=-90 and longitude<0")
def segment_locations(cells: DataFrame) -> DataFrame:
    return land.longitude_segment(land.default_locations(cells), -90, 0)


@query(
    "cells bathymetry",
    """, lats as (select a.latitude, arg_min(b.latitude, struct_pack(d:=abs(a.latitude-b.latitude), l:=b.latitude)) near from (select distinct latitude from cells) a, (select distinct latitude from bathymetry) b group by 1),
 lons as (select a.longitude, arg_min(b.longitude, struct_pack(d:=abs(a.longitude-b.longitude), l:=b.longitude)) near from (select distinct longitude from cells) a, (select distinct longitude from bathymetry) b group by 1)
 select cell_id, lats.near near_lat, lons.near near_lon, round(depth_m,4) depth_m from cells join lats using (latitude) join lons using (longitude) left join bathymetry b on b.latitude=lats.near and b.longitude=lons.near""",
)
def nearest_grid(cells: DataFrame, bathymetry: DataFrame) -> DataFrame:
    return lookup.nearest_grid(cells.select("cell_id", "latitude", "longitude"), bathymetry).select("cell_id", "near_lat", "near_lon", "depth_m")


@query("cells results", "select c.cell_id, arg_min(r.row_no, r.row_no) row_no, round(arg_min(r.lcoa_per_t, r.row_no),6) lcoa_per_t from cells c join results r on abs(r.latitude+(r.row_no%5)*0.05e0-c.latitude)<=0.125e0 and abs(r.longitude-(r.row_no%5)*0.05e0-c.longitude)<=0.125e0 group by 1", digits=6)
def tolerance_lookup(cells: DataFrame, rows: DataFrame) -> DataFrame:
    shift = F.col("row_no") % 5 * 0.05
    moved = rows.select((F.col("latitude") + shift).alias("latitude"), (F.col("longitude") - shift).alias("longitude"), "row_no", "lcoa_per_t")
    found = lookup.first_within(cells.select(F.col("cell_id").alias("id"), "latitude", "longitude"), moved, "row_no")
    return found.select(F.col("id").alias("cell_id"), "row_no", "lcoa_per_t")


@query("cells results", "select c.cell_id, arg_max(r.row_no, r.row_no) row_no, round(arg_max(r.lcoa_per_t, r.row_no),6) lcoa_per_t from cells c left join results r using (latitude, longitude) group by 1", digits=6)
def exact_lookup(cells: DataFrame, rows: DataFrame) -> DataFrame:
    rows = rows.select("latitude", "longitude", "row_no", "lcoa_per_t")
    return lookup.exact_lookup(cells.select("cell_id", "latitude", "longitude"), rows.withColumn("file_order", F.col("row_no"))).select("cell_id", "row_no", "lcoa_per_t")


@query(
    "cells edges",
    """, bb as (select polygon_order, min(least(x1,x2)) xmin,max(greatest(x1,x2)) xmax,min(least(y1,y2)) ymin,max(greatest(y1,y2)) ymax from edges group by 1),
 hit as (select p.cell_id, e.polygon_order, e.country, sum(case when (e.y1>p.latitude)<>(e.y2>p.latitude) and p.longitude<(e.x2-e.x1)*(p.latitude-e.y1)/(case when e.y2=e.y1 then 1 else e.y2-e.y1 end)+e.x1 then 1 else 0 end)%2=1
  or max(case when (e.x2-e.x1)*(p.latitude-e.y1)=(e.y2-e.y1)*(p.longitude-e.x1) and p.longitude between least(e.x1,e.x2) and greatest(e.x1,e.x2) and p.latitude between least(e.y1,e.y2) and greatest(e.y1,e.y2) then 1 else 0 end)=1 as inside
  from cells p join bb on p.longitude between xmin and xmax and p.latitude between ymin and ymax join edges e using (polygon_order) group by 1,2,3)
 select c.cell_id id, arg_min(h.country, h.polygon_order) country from cells c left join hit h on h.cell_id=c.cell_id and h.inside group by 1""",
)
def country_tag(cells: DataFrame, edges: DataFrame) -> DataFrame:
    return lookup.locate_country(cells.select(F.col("cell_id").alias("id"), F.col("longitude").alias("x"), F.col("latitude").alias("y")), edges)


@query("cells", ", ref as (select latitude, longitude, case when cell_id%2=0 then max_capacity_mw*2e0 end r from cells where cell_id%3<>0) select cell_id, round(coalesce(r,max_capacity_mw),4) max_capacity_mw, round(r,4) max_capacity from cells left join ref using (latitude, longitude)")
def reference_merge(cells: DataFrame) -> DataFrame:
    twice = F.when(F.col("cell_id") % 2 == 0, F.col("max_capacity_mw") * 2)
    reference = cells.where("cell_id % 3 <> 0").select("latitude", "longitude", twice.alias("max_capacity_mw"), twice.alias("max_capacity"))
    return land.merge_reference(cells, reference).select("cell_id", "max_capacity_mw", "max_capacity")


_CAPS = ", long as (select cell_id, 'solar' tech, 'power' kind, greatest(coalesce(max_power_solar_mw,0e0),0e0) cap from legacy union all select cell_id, 'wind', 'power', greatest(coalesce(wind_max_capacity,0e0),0e0) from legacy union all select cell_id, 'solar_tracking', 'power', greatest(max_power_solar_tracking_mw,0e0) from legacy where max_power_solar_tracking_mw is not null union all select cell_id, 'ammonia', 'energy', greatest(max_energy_ammonia_mwh,0e0) from legacy where max_energy_ammonia_mwh is not null)"


@query("legacy", f"{_CAPS} select cell_id, tech, kind, round(cap,4) cap from long")
def caps_long(cells: DataFrame) -> DataFrame:
    return land.extract_caps(cells)


@query("legacy", f"{_CAPS}, w as (select cell_id, max(cap) filter (tech='solar' and kind='power') s, max(cap) filter (tech='solar_tracking' and kind='power') t, max(cap) filter (tech='wind' and kind='power') w, coalesce(sum(cap) filter (kind='power' and tech<>'wind'),0e0) total from long group by 1) select cell_id, round(coalesce(s,t),4) solar_cap_mw, round(coalesce(t,s),4) solar_tracking_cap_mw, round(case when s is null or t is null or abs(s-t)<1e-9 then coalesce(s,t) end,4) shared_solar_cap_mw, round(w,4) wind_cap_mw, round(case when total>0 then total end,4) non_wind_cap_mw from w")
def shared_caps(cells: DataFrame) -> DataFrame:
    return land.resolve_shared_caps(land.extract_caps(cells))


# --- weather -----------------------------------------------------------------------------------------------------------

_DENSE = ", hours as (select unnest(generate_series((select min(ts) from weather),(select max(ts) from weather), interval 1 hour)) ts), n as (select ts, cast(row_number() over (order by ts)-1 as int) hour_index from hours), dense as (select k.cell_id, k.resource, n.ts, hour_index, coalesce(cf,0e0) cf from (select distinct cell_id, resource from weather) k cross join n left join weather w on w.cell_id=k.cell_id and w.resource=k.resource and w.ts=n.ts)"
_FRAME = _DENSE + ", frame as (select cell_id, hour_index, max(cf) filter (resource='solar') solar, max(cf) filter (resource='wind')*0.93e0 wind, coalesce(max(cf) filter (resource='solar_tracking'), max(cf) filter (resource='solar')) solar_tracking from dense group by 1,2)"


@query("weather", f"{_FRAME} select cell_id, hour_index, round(solar,4) solar, round(wind,4) wind, round(solar_tracking,4) solar_tracking, 0e0 grid, 1e0 ramp_dummy from frame")
def weather_frame(rows: DataFrame) -> DataFrame:
    return weather.weather_frame(weather.dense_hours(rows))


@query("weather", f"{_DENSE} select cell_id, resource, cast(hour_index//7 as int) block, round(avg(cf),6) cf from dense where hour_index < (select (max(hour_index)+1)//7*7 from dense) group by 1,2,3", digits=6)
def block_mean(rows: DataFrame) -> DataFrame:
    return weather.block_mean(weather.dense_hours(rows), 7)


@query("weather", f"{_DENSE} select cell_id, resource, cast(hour_index//6 as int) block, round(sum(cf),6) cf, count(*) weights from dense group by 1,2,3", digits=6)
def block_sum_weights(rows: DataFrame) -> DataFrame:
    return weather.block_sum(weather.dense_hours(rows), 6)


@query("weather", 'select cell_id, resource, count(*) "hours" from weather group by 1,2 having count(*) < 8700 or count(*) > 8808')
def odd_year_report(rows: DataFrame) -> DataFrame:
    return tables.odd_years(rows, "cell_id", "resource")


@query("weather", ", w as (select cell_id, ts, case when cast(extract(day from ts) as int)%3=0 then avg(cf) end weight from weather group by 1,2) select cell_id, ts, round(coalesce(last_value(weight ignore nulls) over (partition by cell_id order by ts rows between unbounded preceding and current row), first_value(weight ignore nulls) over (partition by cell_id order by ts rows between current row and unbounded following), 1e0),6) weight from w", digits=6)
def fill_weights(rows: DataFrame) -> DataFrame:
    snapshots = rows.groupBy("cell_id", "ts").agg(F.avg("cf").alias("m")).select("cell_id", "ts", F.when(F.dayofmonth("ts") % 3 == 0, F.col("m")).alias("weight"))
    return weather.filled_weights(snapshots)


@query("bathymetry", "select min(step) step from (select latitude-lag(latitude) over (order by latitude) step from (select distinct latitude from bathymetry)) where step>0")
def axis_step(bathymetry: DataFrame) -> DataFrame:
    return lookup.axis_step(bathymetry, "latitude")


@query("weather")
def adjacent_cluster(rows: DataFrame) -> DataFrame:
    frame = weather.weather_frame(weather.dense_hours(rows)).na.fill(0.0, ["solar", "wind"])
    return weather.cluster_hours(frame, ["solar", "wind"], 6)


@query("weather", f"{_FRAME}, o as (select cell_id, hour_index, abs(lead(coalesce(solar,0e0)) over p - coalesce(solar,0e0)) + abs(lead(coalesce(wind,0e0)) over p - coalesce(wind,0e0)) gap from frame window p as (partition by cell_id order by hour_index)) select cell_id, hour_index, round(gap,9) distance from o", digits=9)
def neighbour_distance(rows: DataFrame) -> DataFrame:
    frame = weather.weather_frame(weather.dense_hours(rows)).na.fill(0.0, ["solar", "wind"]).withColumn("weights", F.lit(1.0))
    return weather.neighbour_distance(frame, ["solar", "wind"]).select("cell_id", "hour_index", "distance")


_MIX = "(values (0,1e0,0e0,1e0),(1,0e0,1e0,0.8e0),(2,2e0,1e0,2.8e0),(3,1e0,2e0,2.6e0)) m(mix,wind_mw,solar_mw,mix_cost)"


MIXES = [(0, 1.0, 0.0, 1.0), (1, 0.0, 1.0, 0.8), (2, 2.0, 1.0, 2.8), (3, 1.0, 2.0, 2.6)]


@query(
    "weather",
    f"{_FRAME}, net as (select cell_id, mix, mix_cost, hour_index, coalesce(wind,0e0)*wind_mw+coalesce(solar,0e0)*solar_mw-0.01e0 net from frame, {_MIX}), run as (select *, sum(net) over (partition by cell_id, mix order by y, hour_index rows unbounded preceding) s from net, (values (0),(1)) yy(y)), fall as (select *, max(s) over (partition by cell_id, mix order by y, hour_index rows unbounded preceding)-s f from run), z as (select cell_id, mix, mix_cost, sum(net) filter (y=0) surplus, max(f) storage, sum(greatest(0e0,-net)) filter (y=0) unmet from fall group by 1,2,3) select cell_id, mix, round(case when surplus>=0 then storage end,9) storage, round(case when surplus>=0 then mix_cost+storage*0.1e0 end,9) cost, round(unmet,9) unmet from z", digits=9)
def capacity_sweep(rows: DataFrame) -> DataFrame:
    return sizing.capacity_sweep(weather.weather_frame(weather.dense_hours(rows)), MIXES, 0.01, 0.1)


@query("weather", f"{_FRAME} select cell_id, round(sum(greatest(0e0,-(coalesce(wind,0e0)*1e0+coalesce(solar,0e0)*1e0-0.05e0))),4) unmet_mwh from frame group by 1")
def backstop_energy(rows: DataFrame) -> DataFrame:
    return sizing.backstop_energy(weather.weather_frame(weather.dense_hours(rows)), 1.0, 1.0, 0.05)


# --- solved designs ----------------------------------------------------------------------------------------------------


@query("dispatch capacity", ", c as (select *, coalesce(lag(p) over o, last_value(p) over (partition by cell_id, name order by ts rows between unbounded preceding and unbounded following)) previous from dispatch window o as (partition by cell_id, name order by ts)) select cell_id, name, ts, round(abs(p-previous),4) change, round(optimum,4) optimum from c join capacity using (cell_id, name) where abs(p-previous) > optimum*0.5e0")
def cyclic_ramp_check(dispatch: DataFrame, capacity: DataFrame) -> DataFrame:
    return checks.ramp_violations(dispatch, capacity, 0.5)


@query("dispatch weather capacity", "select d.cell_id, d.name, d.ts, round(p,4) p, round(optimum*case when name='grid' then 1e0 else cf end,4) most from dispatch d join capacity using (cell_id, name) left join weather w on w.cell_id=d.cell_id and w.resource=d.name and w.ts=d.ts where p > optimum*case when name='grid' then 1e0 else cf end+1e-6")
def availability_check(dispatch: DataFrame, profiles: DataFrame, capacity: DataFrame) -> DataFrame:
    return checks.availability_violations(dispatch, profiles, capacity)


@query("dispatch capacity", "select cell_id, name, ts, round(p,4) p, round(optimum*0.3e0,4) least from dispatch join capacity using (cell_id, name) where name='ammonia_synthesis' and p < optimum*0.3e0")
def minimum_load_check(dispatch: DataFrame, capacity: DataFrame) -> DataFrame:
    return checks.low_load_violations(dispatch, capacity)


_PORTS = "(values ('wind','power',1e0),('solar','power',1e0),('ammonia_synthesis','power',-1e0),('ammonia_synthesis','ammonia',0.16e0)) t(name,bus,coef)"


@query("dispatch", f", net as (select cell_id, ts, bus, sum(p*coef) net from dispatch join {_PORTS} using (name) group by 1,2,3), l as (select *, case when bus='ammonia' then 5e0 else 0e0 end ld from net) select cell_id, ts, bus, round(net,4) net, ld load from l where abs(net-ld) > 1e-3")
def bus_balance(dispatch: DataFrame) -> DataFrame:
    spark = dispatch.sparkSession
    ports = spark.createDataFrame([("wind", "power", 1.0), ("solar", "power", 1.0), ("ammonia_synthesis", "power", -1.0), ("ammonia_synthesis", "ammonia", 0.16)], "name string, bus string, coef double")
    return checks.bus_balance(dispatch, ports, spark.createDataFrame([("ammonia", 5.0)], "bus string, load double"))


@query("capacity legacy", f"{_CAPS}, w as (select cell_id, max(cap) filter (tech='solar') s, max(cap) filter (tech='solar_tracking') t, max(cap) filter (tech='wind') w from long where kind='power' group by 1), z as (select cell_id, coalesce(sum(optimum) filter (name='wind'),0e0) wind, coalesce(sum(optimum) filter (name in ('solar','solar_tracking')),0e0) solar from capacity group by 1), v as (select cell_id, unnest(['wind','solar']) rule, unnest([wind,solar]) size, unnest([w, case when s is null or t is null or abs(s-t)<1e-9 then coalesce(s,t) end]) cap from z join w using (cell_id)) select cell_id, rule, round(size,4) size, round(cap,4) cap from v where size > cap+1e-6")
def cap_check(capacity: DataFrame, cells: DataFrame) -> DataFrame:
    return checks.cap_violations(capacity, land.resolve_shared_caps(land.extract_caps(cells)))


_WEIGHT = "w as (select ts, case when cast(extract(hour from ts) as int)%2=0 then 1e0 else 2e0 end weight from (select distinct ts from dispatch))"
_OPEX = f"{_WEIGHT}, opex as (select cell_id, name, sum(p*weight*mc) opex from dispatch join w using (ts) join (values ('wind',0.01e0),('ammonia_synthesis',0.5e0)) t(name,mc) using (name) group by 1,2)"


def _opex(dispatch: DataFrame) -> DataFrame:
    weights = dispatch.select("ts").distinct().withColumn("weight", F.when(F.hour("ts") % 2 == 0, 1.0).otherwise(2.0))
    marginal = dispatch.sparkSession.createDataFrame([("wind", 0.01), ("ammonia_synthesis", 0.5)], "name string, marginal_cost double")
    return economics.dispatch_cost(dispatch, weights, marginal)


@query("dispatch", f", {_OPEX} select cell_id, name, round(opex,4) opex from opex")
def dispatch_cost(dispatch: DataFrame) -> DataFrame:
    return _opex(dispatch)


@query("dispatch", "select cell_id, round(coalesce(sum(p) filter (name='wind'),0e0)*0.5e0,4) wind_mwh, round(coalesce(sum(p) filter (name='grid'),0e0)*0.5e0,4) grid_mwh from dispatch group by 1")
def annual_energy(dispatch: DataFrame) -> DataFrame:
    return economics.annual_energy(dispatch, ["wind", "grid"], 0.5)


_CC = f"cc as (select tech, overnight*({_CRF.format(r='rate', n='lifetime')}+om)*case component_type when 'link' then eff else 1e0 end capital_cost from techs)"
_BREAK = (
    f", {_CC}, {_OPEX}, capex as (select cell_id, name, coalesce(capital_cost,0e0)*coalesce(optimum,0e0) capex from capacity left join cc on tech=name), obj as (select cell_id, sum(capex)*1.1e0 objective from capex group by 1),"
    " costs_by as (select cell_id, name, capex, capex c from capex union all select cell_id, name, 0e0, opex from opex), wide as (select cell_id, sum(capex) total_capital, "
    + ", ".join(f"coalesce(sum(c) filter (name='{n}'),0e0) {label}_cost" for label, _, n in COST_COMPONENTS)
    + " from costs_by group by 1), bd as (select cell_id, objective total_cost, wide.* exclude (cell_id), objective-("
    + "+".join(f"{label}_cost" for label, _, _ in COST_COMPONENTS)
    + ") other_cost from obj join wide using (cell_id))"
)


def _breakdown(capacity: DataFrame, dispatch: DataFrame, techs: DataFrame) -> DataFrame:
    capex = economics.capex(capacity, costs.base_costs(techs).withColumnRenamed("tech", "name"))
    objective = capex.groupBy("cell_id").agg((F.sum("capex") * 1.1).alias("objective"))
    return economics.cost_breakdown(capex, _opex(dispatch), objective)


_LABELS = [label for label, _, _ in COST_COMPONENTS]
_LCOA = (
    "lc as (select cell_id, total_cost, 7134.703196e0*8760e0 annual_ammonia_demand_mwh, p annual_ammonia_production_t, total_cost/p lcoa_per_t, "
    + ", ".join(f"{x}_cost/nullif(total_cost,0e0)*100e0 cost_share_{x}_pct, {x}_cost/p lcoa_component_{x}_per_t" for x in _LABELS)
    + ", greatest(other_cost,0e0)/nullif(total_cost,0e0)*100e0 other_cost_pct, greatest(other_cost,0e0)/p lcoa_component_other_per_t, total_capital/nullif(total_cost,0e0)*100e0 capital_cost_share_pct from bd, (select 7134.703196e0/6.25e0*8760e0 p))"
)


@query("capacity dispatch techs", f"{_BREAK}, {_LCOA} select cell_id, round(columns(* exclude (cell_id)),2) from lc", digits=2)
def lcoa_breakdown(capacity: DataFrame, dispatch: DataFrame, techs: DataFrame) -> DataFrame:
    return economics.lcoa(_breakdown(capacity, dispatch, techs), 7134.703196)


_PARTS = [*(f"lcoa_component_{x}_per_t" for x in _LABELS), "lcoa_component_other_per_t"]


@query("capacity dispatch techs", f"{_BREAK}, {_LCOA}, u as (unpivot lc on {', '.join(_PARTS)} into name component value v) select component, round(avg(v),4) mean from u group by 1")
def component_means(capacity: DataFrame, dispatch: DataFrame, techs: DataFrame) -> DataFrame:
    return analysis.component_means(economics.lcoa(_breakdown(capacity, dispatch, techs), 7134.703196), _PARTS)


@query(
    "capacity dispatch techs cells",
    f"{_BREAK}, {_LCOA}, top as (select *, row_number() over (order by lcoa_per_t, latitude, longitude) rank from lc join cells using (cell_id)), u as (unpivot (select * from top where rank<=15) on {', '.join(_PARTS)} into name c value v)"
    " select rank, coalesce(country,'Ocean/Unclaimed') || ' (' || format('{:.1f}, {:.1f}', latitude, longitude) || ')' location, list_aggregate(list_transform(string_split(replace(replace(c,'lcoa_component_',''),'_per_t',''),'_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') component, round(v,4) \"value\" from u",
)
def component_top15_long(capacity: DataFrame, dispatch: DataFrame, techs: DataFrame, cells: DataFrame) -> DataFrame:
    rows = economics.lcoa(_breakdown(capacity, dispatch, techs), 7134.703196).join(cells, "cell_id")
    return analysis.top_components(rows, _PARTS)


_SPLIT = f"""t as ({_TECH_LAST}), s as (select cell_id, techs.*, optimum, optimum*case component_type when 'link' then eff else 1e0 end size, case when t.interest_rate is not null then coalesce(t.build_cost_multiplier,1e0) else 1e0 end mult, coalesce(t.interest_rate, rate) r from capacity join techs on tech=name left join t using (cell_id, tech) where optimum>0),
 q as (select cell_id, sum(build_cost*size*mult/lifetime) b, sum(tech_cost*size/lifetime) tt, sum((tech_cost+build_cost*mult)*size*om) m, sum(greatest(0e0,(tech_cost+build_cost*mult)*size*({_CRF.format(r='r', n='lifetime')})-(tech_cost+build_cost*mult)*size/lifetime)) i, sum(build_cost*size*mult)/sum(build_cost*size) applied, sum(optimum)*1e5 objective from s group by 1),
 split as (select cell_id, b/objective*100e0 build_cost_pct, tt/objective*100e0 tech_cost_pct, m/objective*100e0 om_cost_pct, i/objective*100e0 interest_pct, applied build_cost_multiplier_applied, objective total_cost from q where objective>0)"""


def _splits(capacity: DataFrame, techs: DataFrame, overrides: DataFrame) -> DataFrame:
    known = capacity.join(techs.select(F.col("tech").alias("name")), "name", "left_semi")
    objective = known.where("optimum > 0").groupBy("cell_id").agg((F.sum("optimum") * 1e5).alias("objective"))
    return economics.headline_splits(capacity, techs, overrides, objective).join(objective.withColumnRenamed("objective", "total_cost"), "cell_id")


@query("capacity techs spatial", f", {_SPLIT} select cell_id, round(columns(* exclude (cell_id)),4) from split")
def headline_splits(capacity: DataFrame, techs: DataFrame, spatial: DataFrame) -> DataFrame:
    return _splits(capacity, techs, costs.tech_overrides(spatial))


@query(
    "capacity techs spatial cells",
    f", {_SPLIT}, l as ({_CELL_LAST}), z as (select split.*, land_cost_usd_per_km2_year*10e0/1e6 land_cost_per_t, water_cost_usd_per_m3*1.5e0 water_cost_per_t from split left join l using (cell_id)), y as (select *, total_cost+coalesce(water_cost_per_t,0e0)*1e6+coalesce(land_cost_per_t,0e0)*1e6 every from z)"
    " select cell_id, round(water_cost_per_t*1e6/every*100e0,6) water_cost_pct, round(land_cost_per_t*1e6/every*100e0,6) land_cost_pct, round(build_cost_pct*total_cost/every,6) build_cost_pct, round(tech_cost_pct*total_cost/every,6) tech_cost_pct, round(om_cost_pct*total_cost/every,6) om_cost_pct, round(interest_pct*total_cost/every,6) interest_pct, round(every/1e6,6) lcoa_all_in_per_t from y", digits=6)
def rescaled_splits(capacity: DataFrame, techs: DataFrame, spatial: DataFrame, cells: DataFrame) -> DataFrame:
    overrides, places = costs.both_overrides(spatial)
    rows = _splits(capacity, techs, overrides).join(places, "cell_id", "left")
    rows = rows.withColumns({"annual_ammonia_production_t": F.lit(1e6), "land_used_km2": F.lit(10.0), "water_cost_per_t": F.col("water_cost_usd_per_m3") * 1.5})
    rows = economics.rescale_splits(economics.land_cost_per_t(rows))
    return rows.select("cell_id", "water_cost_pct", "land_cost_pct", "build_cost_pct", "tech_cost_pct", "om_cost_pct", "interest_pct", "lcoa_all_in_per_t")


@query("spatial capacity techs", f", t as ({_TECH_LAST}), {_CC}, j as (select t.cell_id, t.interest_rate r, greatest(coalesce(optimum,0e0),0e0) size, greatest(coalesce(optimum,0e0)*coalesce(capital_cost,0e0),0e0) w from t left join capacity c on c.cell_id=t.cell_id and c.name=t.tech left join cc on cc.tech=t.tech where t.interest_rate is not null) select cell_id, round(coalesce(sum(w*r)/nullif(sum(w),0e0), sum(size*r)/nullif(sum(size),0e0), avg(r)),6) interest_rate_overall from j group by 1", digits=6)
def weighted_interest(spatial: DataFrame, capacity: DataFrame, techs: DataFrame) -> DataFrame:
    rates = costs.tech_overrides(spatial).withColumnRenamed("tech", "name")
    return economics.weighted_interest_rate(rates, capacity, costs.base_costs(techs).withColumnRenamed("tech", "name"))


@query("capacity cells", f", w as (select cell_id, coalesce(sum(optimum) filter (name in ('solar','solar_tracking')),0e0) s, coalesce(sum(optimum) filter (name='wind'),0e0) w from capacity group by 1), a as (select cell_id, s, w, {_ANGLES}, latitude from w left join cells using (cell_id)) select cell_id, round(coalesce(s/case when latitude>=0 then {_SOLAR} end, s*0.02e0)+w*0.2e0,6) land_used_km2 from a", digits=6)
def land_used(capacity: DataFrame, cells: DataFrame) -> DataFrame:
    density = F.when(F.col("latitude") >= 0, solar_density(F.col("latitude")))
    return economics.land_used(capacity, cells.withColumn("solar_density_mw_per_km2", density), 0.02, 0.2)


@query(
    "capacity techs dispatch",
    ", z as (select cell_id, name, optimum*case when component_type='link' then eff else 1e0 end size from capacity left join techs on tech=name), e as (select distinct cell_id from dispatch), c as (select cell_id, "
    + ", ".join(f"sum(size) filter (name='{n}') {n}" for n in ("wind", "solar", "solar_tracking", "electrolysis", "hydrogen_compression", "ammonia_synthesis"))
    + ", "
    + ", ".join(f"sum(size) filter (name='{n}')*2e0 {n}" for n in ("ammonia", "compressed_hydrogen_store", "battery_storage"))
    + ", 0e0 battery_pcs_mw from z group by 1) select cell_id, round(columns(* exclude (cell_id, penalty_link, grid_energy_mwh)),4), penalty_link, grid_energy_mwh from (select c.*, compressed_hydrogen_store/39.4e0 hydrogen_storage_capacity, case when e.cell_id is not null then 0e0 end penalty_link, case when e.cell_id is not null then 0e0 end grid_energy_mwh from c left join e using (cell_id))",
)
def capacity_columns(capacity: DataFrame, techs: DataFrame, dispatch: DataFrame) -> DataFrame:
    links = techs.where("component_type = 'link'").select(F.col("tech").alias("name"), F.col("eff").alias("efficiency"))
    return economics.capacity_columns(capacity, links, economics.annual_energy(dispatch, ["penalty_link", "grid"]), 2.0)


@query("dispatch", "select cell_id, ts, round(sum(p) filter (name='wind'),4) wind, round(sum(p) filter (name='solar'),4) solar, round(sum(-p) filter (name='ammonia_synthesis'),4) ammonia_synthesis from dispatch group by 1,2")
def timeline(dispatch: DataFrame) -> DataFrame:
    return results.timeline(dispatch)


@query("dispatch", "select cell_id, round(arg_max(p, ts)/6.25e0*1e-6/(count(*)/8760e0),9) production_mt_per_year from dispatch where name='ammonia_synthesis' group by 1", digits=9)
def operating_headline(dispatch: DataFrame) -> DataFrame:
    return results.operating_headline(dispatch.where("name = 'ammonia_synthesis'").withColumnRenamed("p", "e"))


@query("spatial", "select file_order, tech, case tech when 'wind' then 'wind' when 'solar' then 'solar' when 'electrolysis' then 'ammonia_synthesis' else 'battery' end today from spatial where file_order is not null")
def normalized_names(spatial: DataFrame) -> DataFrame:
    old = F.when(F.col("tech") == "wind", "OnshoreWind").when(F.col("tech") == "electrolysis", "HB").otherwise(F.col("tech"))
    return spatial.select("file_order", "tech", normalize_name(old, compatible=True).alias("today"))


# --- more of the same ----------------------------------------------------------------------------------------------------


@query(
    "cells spatial",
    """, p as materialized (select s.file_order, s.tech, s.interest_rate, s.build_cost_multiplier, c.latitude+s.file_order%7*0.05e0 la, c.longitude lo from spatial s join cells c using (cell_id)),
 c as materialized (select cell_id id, latitude, longitude from cells),
 near as materialized (select id, latitude, longitude, d.a, e.o from c, (select unnest([-1,0,1]) a) d, (select unnest([-1,0,1]) o) e),
 pairs as materialized (select n.id, p.* from near n join p on floor(n.latitude/0.125e0)+n.a=floor(p.la/0.125e0) and floor(n.longitude/0.125e0)+n.o=floor(p.lo/0.125e0) where abs(p.la-n.latitude)<=0.125e0 and abs(p.lo-n.longitude)<=0.125e0)
 select id, tech, round(arg_max(interest_rate, file_order) filter (interest_rate is not null),6) interest_rate, round(arg_max(build_cost_multiplier, file_order) filter (build_cost_multiplier is not null),6) build_cost_multiplier from pairs group by 1,2""",
    digits=6,
)
def tolerance_overrides(cells: DataFrame, spatial: DataFrame) -> DataFrame:
    moved = spatial.join(cells.select("cell_id", "latitude", "longitude"), "cell_id").withColumn("latitude", F.col("latitude") + F.col("file_order") % 7 * 0.05)
    return lookup.merged_within(cells.select(F.col("cell_id").alias("id"), "latitude", "longitude"), moved, ["tech"], ["interest_rate", "build_cost_multiplier"])


@query("landcover", ", f as (select cast(90-floor(y_index/20e0) as double) latitude, cast(floor(x_index/20e0)-180 as double) longitude, modis_class, avg(percentage/100e0) fraction from landcover group by 1,2,3) select latitude, longitude, modis_class, round(fraction,6) fraction from f where latitude > -75 and latitude <= 75", digits=6)
def land_blocks(landcover: DataFrame) -> DataFrame:
    return land.block_fractions(landcover)


@query("cells", f", a as (select *, {_AREA} area, {_ANGLES} from cells), b as (select *, area*onshore_land_pct/100e0*({_SOLAR}) s, (area*onshore_land_pct/100e0+area*least(greatest(100e0-onshore_land_pct,0e0),100e0)/100e0)*5e0 w from a) select round(sum(s),2) total_max_power_solar_mw, round(sum(w),2) total_max_power_wind_mw, round(sum(s+w),2) total_max_capacity_mw from b", digits=2)
def total_capacity(cells: DataFrame) -> DataFrame:
    return analysis.total_capacity(land.with_capacity(cells.select("latitude", "longitude", "onshore_land_pct")))


@query("cells", f", a as (select *, {_AREA} area, {_ANGLES} from cells), b as (select *, area*onshore_land_pct/100e0*({_SOLAR}*(1e0/0.03e0)/(with z as (select radians(15e0) tilt, radians(90e0-23.44e0) alt) select {_SOLAR} from z)) s, (area*onshore_land_pct/100e0+area*least(greatest(100e0-onshore_land_pct,0e0),100e0)/100e0)*5e0 w from a) select cell_id, round(s,2) max_power_solar_mw, round(s+w,2) max_capacity_mw from b", digits=2)
def recalibrated_cells(cells: DataFrame) -> DataFrame:
    return land.recalibrate_solar(land.with_capacity(cells), 0.03).select("cell_id", "max_power_solar_mw", "max_capacity_mw")


@query("cells", "select latitude, longitude, round(onshore_land_pct,4) land_onshore_pct, round(greatest(100e0-onshore_land_pct,0e0),4) offshore_sea_pct, round(bathymetry_depth_m,4) bathymetry_depth_m, round(max_capacity_mw,4) area_cap_mw from cells")
def land_metadata(cells: DataFrame) -> DataFrame:
    return land.land_metadata(cells).select("latitude", "longitude", "land_onshore_pct", "offshore_sea_pct", "bathymetry_depth_m", "area_cap_mw")


@query("variants", "select variant, round(overnight*om*100e0/100e0+overnight/(rate*100e0+1e0),4) annual from variants")
def legacy_costs(v: DataFrame) -> DataFrame:
    return v.select("variant", legacy_annual_cost(F.col("overnight"), F.col("om") * 100, F.col("rate") * 100 + 1).alias("annual"))


@query("variants", ", o as (select variant, overnight*0.1e0 c, eff*0.9e0 e from variants where variant%2=0) select v.variant, component_type, round(coalesce(case when component_type='link' and v.variant%3=0 then c*coalesce(e,eff) else c end, overnight),4) capital_cost, round(coalesce(e,eff),4) efficiency from variants v left join o on o.variant=v.variant")
def scenario_costs(v: DataFrame) -> DataFrame:
    name = F.col("variant").cast("string").alias("name")
    components = v.select(name, "component_type", F.col("overnight").alias("capital_cost"), F.col("eff").alias("efficiency"), (F.col("variant") % 3 == 0).alias("output_rated"))
    own = v.where("variant % 2 = 0").select(name, (F.col("overnight") * 0.1).alias("capital_cost"), (F.col("eff") * 0.9).alias("efficiency"))
    return costs.scenario_overrides(components, own).select(F.col("name").cast("long").alias("variant"), "component_type", "capital_cost", "efficiency")


@query("capacity", ", w as (select cell_id, coalesce(sum(optimum) filter (name='hydrogen_compression'),0e0) hydrogen_compression, coalesce(sum(optimum) filter (name='compressed_hydrogen_store'),0e0) compressed_hydrogen_store from capacity group by 1) select cell_id, 0e0 battery_pcs_charge, 0e0 battery_pcs_discharge, round(hydrogen_compression,4) hydrogen_compression, round(compressed_hydrogen_store,4) compressed_hydrogen_store, false converter_gap, true too_large from w where compressed_hydrogen_store*0.5e0 > hydrogen_compression+1e-6")
def storage_cycle_check(capacity: DataFrame) -> DataFrame:
    return checks.battery_violations(capacity, 0.954, cycles=0.5)


@query("dispatch techs", ", d as (select distinct cell_id, name from dispatch) select cell_id, name from d where name not in (select tech from techs where tech<>'wind')")
def unmatched_components(dispatch: DataFrame, techs: DataFrame) -> DataFrame:
    used = dispatch.select("cell_id", F.col("name").alias("tech")).distinct()
    return costs.unmatched(used, techs.where("tech <> 'wind'").select(F.col("tech").alias("name"))).select("cell_id", F.col("tech").alias("name"))


@query("weather", ", d as (select distinct cell_id, resource from weather), g as (select cell_id, unnest(['wind','solar_tracking','grid','tidal']) name from (select distinct cell_id from weather)) select count(*) missing from (select distinct name from g) where name not in ('grid') and name not in (select resource from d) and not (name='solar_tracking' and 'solar' in (select resource from d))")
def profile_completeness(rows: DataFrame) -> DataFrame:
    generators = rows.select(F.explode(F.array(*map(F.lit, ("wind", "solar_tracking", "grid", "tidal")))).alias("name")).distinct()
    return weather.missing_profiles(generators, rows).agg(F.count("*").alias("missing"))


@query("cells edges", ", b as (select min(least(x1,x2)) w, max(greatest(x1,x2)) e, min(least(y1,y2)) s, max(greatest(y1,y2)) n from edges where polygon_order=1) select cell_id id, longitude x, latitude y from cells, b where longitude > w and longitude <= e and latitude between s and n")
def country_locations(cells: DataFrame, edges: DataFrame) -> DataFrame:
    points = cells.select(F.col("cell_id").alias("id"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return lookup.locations_of(points, edges, "NATION_1")


@query("capacity techs spatial cells", f", {_SPLIT}, u as (select c.cell_id, sum(optimum) filter (name='wind') wind from capacity c group by 1) select cells.cell_id, latitude, longitude, country, round(total_cost,2) total_cost, round(build_cost_pct,2) build_cost_pct, round(onshore_land_pct,2) land_onshore_pct, round(wind,2) wind_mw from cells left join split using (cell_id) left join u using (cell_id)", digits=2)
def assembled_results(capacity: DataFrame, techs: DataFrame, spatial: DataFrame, cells: DataFrame) -> DataFrame:
    wind = capacity.where("name = 'wind'").groupBy("cell_id").agg(F.sum("optimum").alias("wind_mw"))
    places = cells.select("cell_id", "latitude", "longitude", "country", F.col("onshore_land_pct").alias("land_onshore_pct"))
    splits = _splits(capacity, techs, costs.tech_overrides(spatial)).select("cell_id", "total_cost", "build_cost_pct")
    return results.assemble([splits, wind], places)


# The other modules register theirs; they use what is defined above.
from . import design_queries, file_queries  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "design_queries", "file_queries"]
