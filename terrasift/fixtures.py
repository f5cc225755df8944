"""Inputs of the registered queries, derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The technologies of the default plant.
TECH_VALUES = """(values
 (0,'solar','generator',380000e0,160000e0,220000e0,40e0,0.1e0,0.02e0,1.0e0),
 (1,'solar_tracking','generator',450000e0,230000e0,220000e0,40e0,0.1e0,0.02e0,1.0e0),
 (2,'wind','generator',930000e0,827241.322492e0,102758.677508e0,30e0,0.1e0,0.02e0,1.0e0),
 (3,'ammonia_synthesis','link',1526000e0,763000e0,763000e0,30e0,0.1e0,0.03e0,6.25e0),
 (4,'electrolysis','link',669344.0e0,602409.6e0,66934.4e0,25e0,0.1e0,0.02e0,0.74e0),
 (5,'hydrogen_compression','link',495857.87e0,413380.50885771547e0,82477.36114228456e0,20e0,0.1e0,0.02e0,1.0e0),
 (6,'hydrogen_fuel_cell','link',2475000e0,1980000e0,495000e0,20e0,0.1e0,0.02e0,0.5e0),
 (7,'hydrogen_from_storage','link',1.0e0,0.9e0,0.1e0,20e0,0.05e0,0.0e0,1.0e0),
 (8,'battery_pcs_charge','link',149000e0,84000e0,65000e0,20e0,0.1e0,0.03e0,0.954e0),
 (9,'battery_pcs_discharge','link',1.0e0,0.5e0,0.5e0,20e0,0.1e0,0.0e0,0.954e0),
 (10,'penalty_link','link',100000000e0,80000000e0,20000000e0,1e0,0.1e0,0.0e0,1.0e0),
 (11,'accumulated_penalty','store',100000000e0,80000000e0,20000000e0,1e0,0.1e0,0.0e0,1.0e0),
 (12,'ammonia','store',521.73912e0,417.3913e0,104.34782e0,30e0,0.1e0,0.03e0,1.0e0),
 (13,'battery_storage','store',130000e0,65000e0,65000e0,20e0,0.1e0,0.029e0,1.0e0),
 (14,'compressed_hydrogen_store','store',25000e0,17000e0,8000e0,30e0,0.1e0,0.02e0,1.0e0)
) t(n,tech,component_type,overnight,tech_cost,build_cost,lifetime,rate,om,eff)"""

SQL = {
    "techs": f"select tech,component_type,overnight,tech_cost,build_cost,lifetime,rate,om,eff from {TECH_VALUES}",
    # a variant of a technology for every part: its costs follow the part's price, its life the part's size
    "variants": f"""select p_partkey variant, tech, component_type, overnight*p_retailprice/1000e0 overnight, tech_cost*p_retailprice/1000e0 tech_cost,
 build_cost*p_retailprice/1000e0 build_cost, lifetime+p_size%5 lifetime, case when p_partkey%10=0 then 0e0 else rate end rate, om, eff
 from part join {TECH_VALUES} on p_partkey%15=n""",
    "cells": """select c_custkey cell_id, cast((c_custkey%151)-75 as double) latitude, cast(((c_custkey*37)%360)-180 as double) longitude,
 case when c_custkey%3=0 then 0e0 when c_custkey%3=1 then 100e0 else cast(abs(c_acctbal) as double)%100e0 end onshore_land_pct,
 abs(c_acctbal)/2e0 bathymetry_depth_m,
 case when c_custkey%7=0 then 0e0 else abs(c_acctbal)*10e0 end max_capacity_mw,
 case when c_custkey%3=0 then null else n_name end country
from customer left join nation on c_nationkey=n_nationkey""",
    "landcover": """select cast(300+l_orderkey%60 as int) y_index, cast(l_partkey%60 as int) x_index,
 case l_linenumber when 1 then 0 when 2 then 6 when 3 then 7 when 4 then 8 when 5 then 9 when 6 then 10 else 16 end modis_class,
 avg(l_quantity)*2e0 percentage
from lineitem group by 1,2,3""",
    "bathymetry": """select cast((p_partkey%16)*10-75 as double) latitude,
 cast((cast(floor(p_partkey/16) as bigint)%36)*10-180 as double) longitude, avg(p_size*60e0) depth_m
from part group by 1,2""",
    "spatial": """select o_custkey cell_id, case l_linenumber%4 when 0 then 'wind' when 1 then 'solar' when 2 then 'electrolysis' else 'battery_storage' end tech,
 case when l_linenumber%3=0 then null else l_discount+0.02e0 end interest_rate,
 case when l_returnflag='R' then null else 1e0+l_tax*10e0 end build_cost_multiplier,
 case when l_linestatus='O' then l_quantity end land_cost_usd_per_km2_year,
 case when l_returnflag='A' then l_quantity/10e0 end water_cost_usd_per_m3,
 (l_orderkey*8+l_linenumber)*10000000000+l_partkey%10000*1000000+cast(floor(l_extendedprice*100e0) as bigint)%1000000 file_order
from lineitem join orders on l_orderkey=o_orderkey""",
    "results": """select cast((c_custkey%151)-75 as double) latitude, cast(((c_custkey*37)%360)-180 as double) longitude, case when c_custkey%3=0 then null else n_name end country,
 o_totalprice/200e0 lcoa_per_t, case when o_orderkey%11=0 then 5000e0 else 0e0 end grid_energy_mwh,
 o_orderkey%4 file_rank, o_orderkey row_no
from orders join customer on o_custkey=c_custkey left join nation on c_nationkey=n_nationkey""",
    "weather": """select user_id cell_id, case event_type when 'error' then 'solar' when 'signup' then 'solar_tracking' else 'wind' end resource,
 date_trunc('hour',ts) ts, least(avg(value)/300e0,1e0) cf from events group by 1,2,3""",
    "capacity": """select o_custkey cell_id, case l_linenumber when 1 then 'wind' when 2 then 'solar' when 3 then 'electrolysis' when 4 then 'ammonia_synthesis' when 5 then 'hydrogen_compression' when 6 then 'compressed_hydrogen_store' else 'battery_storage' end name,
 sum(l_quantity) optimum from lineitem join orders on l_orderkey=o_orderkey group by 1,2""",
    "dispatch": """select user_id cell_id, case event_type when 'error' then 'wind' when 'signup' then 'solar' else 'ammonia_synthesis' end name,
 date_trunc('hour',ts) ts, sum(value) p from events group by 1,2,3""",
    "levels": """select user_id cell_id, case event_type when 'error' then 'battery_storage' when 'signup' then 'compressed_hydrogen_store' else 'ammonia' end name,
 date_trunc('hour',ts) ts, sum(abs(value)) e from events group by 1,2,3""",
    "parts": "select 'brand_'||l_suppkey%40 tech, l_returnflag part, l_discount*100e0 percent, l_extendedprice cost from lineitem",
    # four boxes of countries' own longitudes with shared borders, one for each nation, and a hole in every third
    "edges": """select n_name country, cast(n_nationkey as int) polygon_order, seg, x1+14.4e0*n_nationkey x1, y1, x2+14.4e0*n_nationkey x2, y2 from nation
 join (values (0,-180e0,-60e0,-180e0,60e0,1),(1,-180e0,60e0,-165.6e0,60e0,1),(2,-165.6e0,60e0,-165.6e0,-60e0,1),(3,-165.6e0,-60e0,-180e0,-60e0,1),
 (4,-176e0,-9.5e0,-176e0,10.5e0,3),(5,-176e0,10.5e0,-170e0,10.5e0,3),(6,-170e0,10.5e0,-170e0,-9.5e0,3),(7,-170e0,-9.5e0,-176e0,-9.5e0,3)) t(seg,x1,y1,x2,y2,every) on n_nationkey%every=0""",
    "legacy": """select c_custkey cell_id, case when c_custkey%4=0 then null else abs(c_acctbal) end max_power_solar_mw, case when c_custkey%5=0 then abs(c_acctbal)*2e0 end max_power_solar_tracking_mw,
 case when c_custkey%6=0 then c_acctbal end max_energy_ammonia_mwh, case when c_custkey%2=0 then abs(c_acctbal)*3e0 end wind_max_capacity from customer""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input over the tables of sf_dir."""
    sql = SQL[name]
    for table in TABLES:
        if table in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


def with_inputs(names: str, body: str) -> str:
    """body as SQL with the named inputs as common tables."""
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in names.split()) + "\n" + body
