"""Schemas of the tables, column checks, and the constants that fix meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def _struct(*columns: tuple[str, str]) -> T.StructType:
    """Nullable columns of (name, type)."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


#: Columns of the tables, as their files name them.
WEATHER = _struct(
    ("resource", "string"),
    ("latitude", "double"),
    ("longitude", "double"),
    ("cf", "double"),
    ("hour_index", "int"),
    ("ts", "timestamp"),
)
LANDCOVER = _struct(
    ("percentage", "double"),
    ("y_index", "int"),
    ("x_index", "int"),
    ("modis_class", "int"),
)
BATHYMETRY = _struct(
    ("latitude", "double"),
    ("longitude", "double"),
    ("depth_m", "double"),
)
CELLS = _struct(
    ("latitude", "double"),
    ("longitude", "double"),
    ("availability", "double"),
    ("area", "double"),
    ("onshore_land_pct", "double"),
    ("offshore_sea_pct", "double"),
    ("onshore_area_km2", "double"),
    ("offshore_area_km2", "double"),
    ("bathymetry_depth_m", "double"),
    ("wind_availability", "double"),
    ("solar_availability", "double"),
    ("solar_area_km2", "double"),
    ("wind_area_km2", "double"),
    ("wind_density_mw_per_km2", "double"),
    ("solar_density_mw_per_km2", "double"),
    ("max_power_solar_mw", "double"),
    ("max_power_wind_mw", "double"),
    ("max_capacity_mw", "double"),
    ("solar_max_capacity", "double"),
    ("wind_max_capacity", "double"),
    ("max_capacity", "double"),
)
LEGACY_CELLS = _struct(
    ("latitude", "double"),
    ("longitude", "double"),
    ("availability", "double"),
    ("area", "double"),
    ("wind_availability", "double"),
    ("solar_availability", "double"),
    ("onshore_land_pct", "double"),
)
TECHS = _struct(
    ("scenario", "string"),
    ("name", "string"),
    ("component_type", "string"),
    ("overnight_cost_per_mw", "double"),
    ("overnight_cost_per_mwh", "double"),
    ("tech_cost_per_mw", "double"),
    ("tech_cost_per_mwh", "double"),
    ("build_cost_per_mw", "double"),
    ("build_cost_per_mwh", "double"),
    ("land_use_km2_per_mw", "double"),
    ("land_use_km2_per_mwh", "double"),
    ("lifetime_years", "double"),
    ("interest_rate", "double"),
    ("fixed_om_fraction", "double"),
    ("standing_loss_fraction_per_day", "double"),
    ("overall_efficiency", "double"),
    ("carriers_in", "map<string,double>"),
    ("carriers_out", "map<string,double>"),
)
SCENARIO_META = _struct(
    ("scenario", "string"),
    ("currency", "string"),
    ("water_usage_m3_per_t_nh3", "double"),
    ("water_cost_baseline_usd_per_m3", "double"),
    ("grid_p_nom_mw", "double"),
    ("grid_marginal_cost", "double"),
)
BUSES = _struct(
    ("name", "string"),
    ("carrier", "string"),
    ("control", "string"),
    ("generator", "string"),
    ("comment", "string"),
)
GENERATORS = _struct(
    ("name", "string"),
    ("bus", "string"),
    ("control", "string"),
    ("comment", "string"),
    ("p_nom", "double"),
    ("marginal_cost", "double"),
    ("capital_cost", "double"),
    ("p_nom_extendable", "boolean"),
)
LINKS = _struct(
    ("name", "string"),
    ("bus0", "string"),
    ("bus1", "string"),
    ("carrier", "string"),
    ("bus2", "string"),
    ("comment", "string"),
    ("efficiency", "double"),
    ("p_nom_max", "double"),
    ("p_min_pu", "double"),
    ("capital_cost", "double"),
    ("marginal_cost", "double"),
    ("ramp_limit_up", "double"),
    ("ramp_limit_down", "double"),
    ("efficiency2", "double"),
    ("p_nom_extendable", "boolean"),
)
STORES = _struct(
    ("name", "string"),
    ("bus", "string"),
    ("carrier", "string"),
    ("comment", "string"),
    ("e_nom_max", "double"),
    ("e_initial", "double"),
    ("capital_cost", "double"),
    ("standing_loss", "double"),
    ("e_nom_extendable", "boolean"),
    ("e_cyclic", "boolean"),
)
LOADS = _struct(
    ("name", "string"),
    ("bus", "string"),
    ("comment", "string"),
    ("p_set", "double"),
)
SPATIAL_COSTS = _struct(
    ("tech", "string"),
    ("lat", "double"),
    ("lon", "double"),
    ("interest_rate", "double"),
    ("build_cost_multiplier", "double"),
    ("land_cost_usd_per_km2_year", "double"),
    ("water_cost_usd_per_m3", "double"),
    ("file_order", "bigint"),
)
COUNTRY_EDGES = _struct(
    ("country", "string"),
    ("x1", "double"),
    ("y1", "double"),
    ("x2", "double"),
    ("y2", "double"),
    ("polygon_order", "int"),
    ("part", "int"),
    ("seg", "int"),
)
LOCATIONS = _struct(
    ("lat", "double"),
    ("lon", "double"),
)
SOLVED_CAPACITY = _struct(
    ("component_type", "string"),
    ("name", "string"),
    ("lat", "double"),
    ("lon", "double"),
    ("value", "double"),
)
SOLVED_DISPATCH = _struct(
    ("component_type", "string"),
    ("name", "string"),
    ("port", "string"),
    ("lat", "double"),
    ("lon", "double"),
    ("p", "double"),
    ("snapshot", "int"),
)
SOLVED_OBJECTIVE = _struct(
    ("lat", "double"),
    ("lon", "double"),
    ("objective", "double"),
)

HYDROGEN_MWH_PER_T, AMMONIA_MWH_PER_T, AMMONIA_HYDROGEN_SHARE = 39.4, 6.25, 0.18
HOURS_PER_YEAR = 8760
TOLERANCE_DEGREES, KEY_DECIMALS = 0.125, 4
WAKE_FACTOR = 0.93
EARTH_RADIUS_KM, WIND_KM2_PER_GW = 6371.0, 200.0
DEFAULT_LIFETIME, DEFAULT_RATE, DEFAULT_OM, DEFAULT_WATER_M3_PER_T = 20.0, 0.07, 0.0, 1.5
COST_CLIP = 2000.0
#: Width of a band of longitude that places are stored by.
BAND_DEGREES = 30
#: What a row of a sheet is about, as far as the sheet has it.
SHEET_KEYS = ("cell_id", "name", "ts")
#: Share of a land class that wind can use; classes that aren't listed have none. Class 0 is water.
WIND_SHARE = {0: 1.0, 6: 0.5, 7: 0.5, 8: 0.15, 9: 0.2, 10: 0.2, 16: 1.0}
#: Depth in metres and cost multiplier, by curve.
DEPTH_CURVES = {"wind": ((0, 1.3), (60, 1.8), (300, 2.5), (1500, 3.5)), "plant": ((0, 1.1), (60, 1.3), (300, 1.8), (1500, 2.5))}
#: Photovoltaic module and field.
PV_WIDTH_M, PV_LENGTH_M, PV_KW, PV_DECLINATION = 1.21, 2.06, 0.45, 23.44
PV_TILT, PV_ALTITUDE, PV_GROUND_COVER = (15.0, 55.0), (5.0, 89.0), (0.05, 0.8)
#: Cost components that a breakdown reports, with the kind and name of the plant component behind each.
COST_COMPONENTS = (
    ("wind", "generator", "wind"),
    ("solar", "generator", "solar"),
    ("solar_tracking", "generator", "solar_tracking"),
    ("electrolyser", "link", "electrolysis"),
    ("ammonia_synthesis", "link", "ammonia_synthesis"),
    ("hydrogen_compression", "link", "hydrogen_compression"),
    ("hydrogen_store", "store", "compressed_hydrogen_store"),
    ("ammonia_store", "store", "ammonia"),
    ("battery", "store", "battery_storage"),
)
#: Old component names and today's.
COMPONENT_NAMES = {
    "Power": "power",
    "Ammonia": "ammonia",
    "PowerStorage": "power_storage",
    "Hydrogen": "hydrogen",
    "HydrogenStorage": "hydrogen_storage",
    "RampPenalty": "ramp_penalty",
    "RampPenaltyDest": "ramp_penalty_dest",
    "Wind": "wind",
    "OnshoreWind": "wind",
    "Solar": "solar",
    "SolarTracking": "solar_tracking",
    "Grid": "grid",
    "RampDummy": "ramp_dummy",
    "Electrolysis": "electrolysis",
    "HydrogenCompression": "hydrogen_compression",
    "HydrogenFromStorage": "hydrogen_from_storage",
    "HB": "ammonia_synthesis",
    "BatteryInterfaceIn": "battery_interface_in",
    "BatteryInterfaceOut": "battery_interface_out",
    "HydrogenFuelCell": "hydrogen_fuel_cell",
    "PenaltyLink": "penalty_link",
    "CompressedH2Store": "compressed_hydrogen_store",
    "Battery": "battery",
    "BatteryStorage": "battery",
    "battery_storage": "battery",
    "AccumulatedPenalty": "accumulated_penalty",
}
#: Result columns that are powers, and that are energies.
POWER_COLUMNS = ("wind", "solar", "solar_tracking", "grid", "ramp_dummy", "electrolysis", "hydrogen_compression", "hydrogen_from_storage", "ammonia_synthesis", "battery_interface_in", "battery_interface_out", "hydrogen_fuel_cell")
ENERGY_COLUMNS = ("ammonia", "compressed_hydrogen_store", "battery", "battery_storage", "accumulated_penalty", "penalty_link")
RATE_ALIASES = {"electrolysis": "electrolyser", "compressed_hydrogen_store": "hydrogen_store", "ammonia": "ammonia_store"}


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower() for c in df.columns))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; present: {', '.join(df.columns)}")
    return df
