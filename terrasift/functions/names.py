"""Names of components and columns."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COMPONENT_NAMES, ENERGY_COLUMNS, POWER_COLUMNS


def normalize_name(name: Column, compatible: bool = False) -> Column:
    """Today's name of a component; unknown names stay, null stays null. battery_storage stays too, as stores carry that
    name, unless compatible."""
    known = {k: v for k, v in COMPONENT_NAMES.items() if compatible or k != "battery_storage"}
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*known.items()))), name), name)


def currency_slug(currency: Column) -> Column:
    return F.lower(F.trim(currency))


def with_units(df: DataFrame) -> DataFrame:
    """Result columns renamed to carry their units."""
    names = {c: f"{c.lower()}_mw" for c in df.columns if c.lower() in POWER_COLUMNS} | {c: f"{c.lower()}_mwh" for c in df.columns if c.lower() in ENERGY_COLUMNS}
    names |= {"hydrogen_storage_capacity": "hydrogen_storage_capacity_t", "land_capacity_cap": "land_capacity_cap_mw", "percent_onshore": "land_onshore_pct", "percent_onshore_pct": "land_onshore_pct"}
    return df.withColumnsRenamed(names)


def component_label(column: Column) -> Column:
    """lcoa_component_hydrogen_store_eur_per_t as Hydrogen Store."""
    return F.initcap(F.regexp_replace(F.regexp_replace(column, "^lcoa_component_|(_[a-z]{3})?_per_t$", ""), "_", " "))


def location_label(country: Column, latitude: Column, longitude: Column) -> Column:
    return F.format_string("%s (%.1f, %.1f)", F.coalesce(country, F.lit("Ocean/Unclaimed")), latitude, longitude)


def cap_columns(columns: list[str]) -> list[tuple[str, str, str]]:
    """(column, tech, kind) of the columns max_power_<tech>_mw and max_energy_<tech>_mwh."""
    found = ((c, re.fullmatch(r"max_(?:power_(.+)_mw|energy_(.+)_mwh)", c.strip().lower())) for c in columns)
    return [(c, m[1] or m[2], "power" if m[1] else "energy") for c, m in found if m]


def metric_column(df: DataFrame) -> str:
    """The cost column to show: of the one currency in the table, else of usd, else the first."""
    costs = [c for c in df.columns if re.fullmatch(r"lcoa_[a-z]{3}_per_t", c)]
    if "currency" in df.columns:
        seen = [r[0] for r in df.select(currency_slug(F.col("currency"))).dropna().distinct().limit(2).collect()]
        if len(seen) == 1 and f"lcoa_{seen[0]}_per_t" in costs:
            return f"lcoa_{seen[0]}_per_t"
    if not costs:
        raise ValueError("no column lcoa_<currency>_per_t")
    return "lcoa_usd_per_t" if "lcoa_usd_per_t" in costs else costs[0]
