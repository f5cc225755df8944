"""From land cover to the table of cells and their capacity."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import effective_depth
from ..functions.geometry import cell_area_km2, clip, coarse_latitude, coarse_longitude, solar_density, wind_density
from ..functions.names import cap_columns
from ..schemas import CELLS, WIND_SHARE
from .lookup import nearest_grid

OVERRIDDEN = ("max_capacity_mw", "max_power_wind_mw", "max_power_solar_mw", "max_capacity", "wind_max_capacity", "solar_max_capacity")


def class_fractions(landcover: DataFrame, south: float = -75, north: float = 75) -> DataFrame:
    """Mean share of each land class in each whole-degree cell within the band. The band is asked of the raw row numbers
    too, so that it reaches the scan."""
    rows = landcover.where(F.col("y_index").between(int((90 - north - 1) * 20), int((90 - south + 1) * 20)))
    rows = rows.select(coarse_latitude(F.col("y_index")).alias("latitude"), coarse_longitude(F.col("x_index")).alias("longitude"), "modis_class", (F.col("percentage") / 100).alias("fraction"))
    return rows.where(F.col("latitude").between(south, north)).groupBy("latitude", "longitude", "modis_class").agg(F.avg("fraction").alias("fraction"))


def block_fractions(landcover: DataFrame, south: float = -75, north: float = 75) -> DataFrame:
    """As class_fractions by blocks of 20 fine rows, which carry the floor of their first row's latitude: nearly the same
    cells, labelled one degree higher. Kept to compare with tables that were made that way."""
    latitude = (90 - F.floor(F.col("y_index") / 20)).cast("double")
    rows = landcover.select(latitude.alias("latitude"), coarse_longitude(F.col("x_index")).alias("longitude"), "modis_class", (F.col("percentage") / 100).alias("fraction"))
    return rows.where((F.col("latitude") > south) & (F.col("latitude") <= north)).groupBy("latitude", "longitude", "modis_class").agg(F.avg("fraction").alias("fraction"))


def availability(fractions: DataFrame) -> DataFrame:
    """Wind availability by class shares, and land and sea of each cell, in one pass."""
    share = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*WIND_SHARE.items()))), F.col("modis_class")), F.lit(0.0))
    cells = fractions.groupBy("latitude", "longitude").agg(F.sum(F.col("fraction") * share).alias("wind"), F.sum(F.when(F.col("modis_class") == 0, F.col("fraction")).otherwise(0.0)).alias("water"))
    water = clip(F.coalesce(F.col("water"), F.lit(0.0)), 0, 1)
    cells = cells.select("latitude", "longitude", clip(F.col("wind"), 0, 1).alias("wind_availability"), (1 - water).alias("solar_availability"), clip((1 - water) * 100, 0, 100).alias("onshore_land_pct"))
    return cells.withColumn("availability", F.greatest("wind_availability", "solar_availability"))


def with_capacity(cells: DataFrame) -> DataFrame:
    """Areas, densities and capacities of cells(latitude, onshore_land_pct, ...)."""
    cells = cells.withColumn("area", cell_area_km2(F.col("latitude")))
    cells = cells.withColumn("offshore_sea_pct", clip(100 - F.col("onshore_land_pct"), 0, 100))
    cells = cells.withColumns({"onshore_area_km2": F.col("area") * F.col("onshore_land_pct") / 100, "offshore_area_km2": F.col("area") * F.col("offshore_sea_pct") / 100})
    cells = cells.withColumns({"solar_area_km2": F.col("onshore_area_km2"), "wind_area_km2": F.col("onshore_area_km2") + F.col("offshore_area_km2"), "solar_density_mw_per_km2": solar_density(F.col("latitude")), "wind_density_mw_per_km2": wind_density()})
    cells = cells.withColumns({"max_power_solar_mw": clip(F.col("onshore_area_km2") * F.col("solar_density_mw_per_km2"), 0), "max_power_wind_mw": clip(F.col("wind_area_km2") * F.col("wind_density_mw_per_km2"), 0)})
    cells = cells.withColumn("max_capacity_mw", F.col("max_power_solar_mw") + F.col("max_power_wind_mw"))
    aliases = {"availability": (F.col("max_capacity_mw") > 0).cast("double"), "solar_max_capacity": F.col("max_power_solar_mw"), "wind_max_capacity": F.col("max_power_wind_mw"), "max_capacity": F.col("max_capacity_mw")}
    return cells.withColumns(aliases)


def merge_reference(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """Capacity columns take the reference's values where it has them."""
    columns = [c for c in OVERRIDDEN if c in reference.columns]
    reference = reference.select("latitude", "longitude", *(F.col(c).alias(f"{c}_ref") for c in columns))
    merged = cells.join(reference, ["latitude", "longitude"], "left")
    own = lambda c: F.col(c) if c in cells.columns else F.lit(None).cast("double")
    return merged.withColumns({c: F.coalesce(F.col(f"{c}_ref"), own(c)) for c in columns}).drop(*(f"{c}_ref" for c in columns))


def build_cells(landcover: DataFrame, bathymetry: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    cells = availability(class_fractions(landcover))
    if bathymetry is None:
        cells = cells.withColumn("bathymetry_depth_m", F.lit(None).cast("double"))
    else:
        cells = nearest_grid(cells, bathymetry).drop("near_lat", "near_lon").withColumnRenamed("depth_m", "bathymetry_depth_m")
    cells = with_capacity(cells)
    cells = merge_reference(cells, reference) if reference is not None else cells
    return cells.select(*CELLS.names)


def recalibrate_solar(cells: DataFrame, km2_per_mw: float) -> DataFrame:
    """Solar density scaled to a technology's own land use at the equator, and the capacities that follow."""
    cells = cells.withColumn("solar_density_mw_per_km2", solar_density(F.col("latitude"), km2_per_mw=km2_per_mw))
    if "onshore_area_km2" not in cells.columns:
        return cells
    cells = cells.withColumn("max_power_solar_mw", clip(F.col("onshore_area_km2") * F.col("solar_density_mw_per_km2"), 0))
    cells = cells.withColumn("max_capacity_mw", F.col("max_power_solar_mw") + F.coalesce("max_power_wind_mw", F.lit(0.0)))
    return cells.withColumns({"solar_max_capacity": F.col("max_power_solar_mw"), "max_capacity": F.col("max_capacity_mw")})


def base_land_use(techs: DataFrame) -> DataFrame:
    """The land use of solar, else of solar_tracking, of each scenario."""
    usable = techs.where(F.col("name").isin("solar", "solar_tracking") & (F.col("land_use_km2_per_mw") > 0))
    return usable.groupBy("scenario").agg(F.min_by("land_use_km2_per_mw", "name").alias("land_use_km2_per_mw"))


def default_locations(cells: DataFrame) -> DataFrame:
    """Places with capacity, by the first of max_capacity_mw, max_capacity and availability that the table has."""
    column = next((c for c in ("max_capacity_mw", "max_capacity", "availability") if c in cells.columns), None)
    if column is None:
        raise ValueError("no capacity column")
    return cells.where(F.col(column) > 0).select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def longitude_segment(locations: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    return locations.where((F.col("lon") >= (-180 if low is None else low)) & (F.col("lon") < (180 if high is None else high)))


def cell_classes(cells: DataFrame) -> DataFrame:
    kind = F.when(F.col("onshore_land_pct") == 0, "ocean").when(F.col("onshore_land_pct") < 100, "coastal").otherwise("land")
    return cells.where("onshore_land_pct is not null").groupBy(kind.alias("cell_class")).agg(F.count("*").alias("cells"))


def with_effective_depth(cells: DataFrame) -> DataFrame:
    return cells.withColumn("depth", effective_depth(F.col("onshore_land_pct"), F.col("bathymetry_depth_m")))


def land_metadata(cells: DataFrame) -> DataFrame:
    """Land columns of a result, by the first source column that is there and not null."""

    def first(*names: str):
        there = [F.col(n) for n in names if n in cells.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("double")

    onshore = F.coalesce(first("onshore_land_pct"), first("onshore_fraction") * 100)
    columns = {
        "land_onshore_pct": onshore,
        "offshore_sea_pct": F.when(onshore.isNotNull(), clip(100 - onshore, 0)),
        "land_cell_area_km2": first("area"),
        "onshore_area_km2": first("onshore_area_km2"),
        "offshore_area_km2": first("offshore_area_km2"),
        "bathymetry_depth_m": first("bathymetry_depth_m"),
        "area_cap_mw": first("max_capacity_mw", "max_capacity"),
        "solar_area_used_km2": first("solar_area_km2", "onshore_area_km2"),
        "wind_area_used_km2": first("wind_area_km2", "onshore_wind_area_km2"),
    }
    caps = [F.col(c).alias(c.lower()) for c, _, _ in cap_columns(cells.columns)]
    return cells.select("latitude", "longitude", *(v.alias(k) for k, v in columns.items()), *caps)


def extract_caps(cells: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """(id_col, tech, kind, cap): explicit columns, else the legacy ones for wind and solar, else max_capacity_mw or
    max_capacity for both. With explicit columns wind and solar without a value are 0, with legacy ones wind is."""
    explicit = cap_columns(cells.columns)
    pick = lambda name: F.col(name).cast("double") if name in cells.columns else F.lit(None).cast("double")
    own = {(t, k): pick(c) for c, t, k in explicit}
    legacy = {"solar": pick("solar_max_capacity"), "wind": pick("wind_max_capacity")}
    has_legacy = legacy["solar"].isNotNull() | legacy["wind"].isNotNull()
    for tech, column in legacy.items():
        own[tech, "power"] = F.coalesce(own.get((tech, "power"), F.lit(None).cast("double")), column)
    if any(k == "power" for _, _, k in explicit):
        own |= {(t, "power"): F.coalesce(own[t, "power"], F.lit(0.0)) for t in ("wind", "solar")}
    else:
        own["wind", "power"] = F.coalesce(own["wind", "power"], F.when(has_legacy, 0.0))
    entry = lambda t, k, v: F.struct(F.lit(t).alias("tech"), F.lit(k).alias("kind"), F.greatest(v, F.lit(0.0)).alias("cap"))
    found = F.filter(F.array(*(F.when(v.isNotNull(), entry(t, k, v)) for (t, k), v in own.items())), lambda x: x.isNotNull())
    fallback = F.coalesce(pick("max_capacity_mw"), pick("max_capacity"))
    spare = F.when(fallback.isNotNull(), F.array(entry("wind", "power", fallback), entry("solar", "power", fallback)))
    return cells.select(id_col, F.inline(F.when(F.size(found) > 0, found).otherwise(spare)))


def resolve_shared_caps(caps: DataFrame, id_col: str = "cell_id", fixed: tuple[str, ...] = ()) -> DataFrame:
    """One row per cell: solar and solar_tracking caps, where one stands for both if the other is missing, the cap that
    they share, wind's, and the sum of all power caps but wind's. Techs in fixed can't be extended and have 0."""
    of = lambda tech: F.max(F.when((F.col("tech") == tech) & (F.col("kind") == "power"), F.col("cap")))
    wide = caps.groupBy(id_col).agg(of("solar").alias("s"), of("solar_tracking").alias("t"), of("wind").alias("wind_cap_mw"), F.sum(F.when((F.col("kind") == "power") & (F.col("tech") != "wind"), F.col("cap")).otherwise(0.0)).alias("total"))
    s, t = F.coalesce("s", "t"), F.coalesce("t", "s")
    cap = lambda tech, c: F.when(c.isNotNull(), F.lit(0.0) if tech in fixed else c)
    shared = F.when(F.col("s").isNull() | F.col("t").isNull() | (F.abs(F.col("s") - F.col("t")) < 1e-9), s)
    return wide.select(id_col, cap("solar", s).alias("solar_cap_mw"), cap("solar_tracking", t).alias("solar_tracking_cap_mw"), shared.alias("shared_solar_cap_mw"), "wind_cap_mw", F.when(F.col("total") > 0, F.col("total")).alias("non_wind_cap_mw"))
