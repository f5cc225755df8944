"""Readers. Missing optional files are empty tables; missing columns are errors; nothing is inferred in production paths."""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.names import normalize_name

COUNTRY_PROPERTIES = ("ADMIN", "NAME", "name", "COUNTRY", "Country")


def _read(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """A table by its suffix: Parquet, JSON or, else, CSV with a header. CSV columns are matched by name."""
    first = path if isinstance(path, str) else path[0]
    if first.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if first.endswith((".json", ".jsonl")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    return spark.read.csv(path, header=True, inferSchema=False)


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """df, as it was read, with a number to order by: file by name, place of the block in it, then row.

    Aggregates keep a number in place, where they would have to sort all rows for a struct with the file's name. The names
    of the files are broadcast, in both ways to write a path without a host.
    """
    files = sorted(df.inputFiles())
    names = dict(pair for k, f in enumerate(files) for pair in ((f, k), (re.sub(r"^([^:/]+):///", r"\1:/", f), k)))
    ranks = df.sparkSession.createDataFrame(list(names.items()), "__file string, __rank long")
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    rank = F.coalesce("__rank", F.raise_error(F.concat(F.lit("not among the files: "), "__file")).cast("long"))
    # files up to 4 TB, a row's number in its task below 2 ** 63; more than a million files are an error
    place = (rank * F.lit(1 << 42) + F.col("__block")).cast("decimal(20, 0)") * F.lit(Decimal(1 << 63)) + F.col("__row")
    return rows.join(F.broadcast(ranks), "__file", "left").select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema that df has, cast to its types, NaN as null, then df's other columns."""
    def cast(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`").cast(f.dataType)
        return F.when(~F.isnan(c), c).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c.alias(f.name)

    known = [f for f in schema if f.name in df.columns]
    return df.select(*(cast(f) for f in known), *(F.col(f"`{c}`") for c in df.columns if c not in schema.names))


def _optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return _read(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_plant(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Buses, generators, links, stores and loads, which all have names."""
    kinds = {"buses": S.BUSES, "generators": S.GENERATORS, "links": S.LINKS, "stores": S.STORES, "loads": S.LOADS}
    return {k: typed(S.require_columns(_read(spark, f"{folder}/{k}.csv"), "name"), schema) for k, schema in kinds.items()}


def read_techs(spark: SparkSession, path: str, scenario: str | None = None) -> DataFrame:
    techs = typed(S.require_columns(_read(spark, path, S.TECHS), "name", "component_type"), S.TECHS)
    techs = techs.withColumns({"component_type": F.lower("component_type"), "name": normalize_name(F.col("name"))})
    return techs.where(F.col("scenario") == scenario) if scenario else techs


def rejected_techs(techs: DataFrame) -> DataFrame:
    """Rows of techs with a reason: an unknown kind, or no overnight cost of its kind."""
    unknown = F.when(~F.coalesce(F.col("component_type").isin("generator", "link", "store"), F.lit(False)), "unknown component_type")
    cost = F.when(F.col("component_type") == "store", F.col("overnight_cost_per_mwh")).otherwise(F.col("overnight_cost_per_mw"))
    return techs.withColumn("reason", F.coalesce(unknown, F.when(cost.isNull(), "no overnight cost"))).where("reason is not null")


def read_scenario(spark: SparkSession, path: str) -> DataFrame:
    meta = typed(_read(spark, path, S.SCENARIO_META), S.SCENARIO_META)
    return meta.withColumn("currency", F.upper(F.trim("currency")))


def read_spatial_costs(spark: SparkSession, path: str) -> DataFrame:
    """The cost table; a column file_order, if it has none, is the place of a row in its file, files by name."""
    costs = _optional(spark, path, S.SPATIAL_COSTS)
    if "file_order" not in (c.strip().lower() for c in costs.columns):
        costs = in_file_order(costs, "file_place")
    costs = typed(S.require_columns(S.lower_columns(costs), "lat", "lon", "tech", "interest_rate"), S.SPATIAL_COSTS)
    costs = costs.withColumnRenamed("file_place", "file_order")
    return costs.withColumn("tech", normalize_name(F.col("tech")))


def read_cells(spark: SparkSession, path: str, legacy: str | None = None) -> DataFrame:
    """The land table, else the legacy one, else a table without rows."""
    cells = _optional(spark, path, S.CELLS)
    if legacy and cells.isEmpty():
        cells = _optional(spark, legacy, S.LEGACY_CELLS)
    return typed(S.require_columns(S.lower_columns(cells), "latitude", "longitude"), S.CELLS)


def read_legacy_cells(spark: SparkSession, path: str) -> DataFrame:
    return typed(S.require_columns(S.lower_columns(_read(spark, path)), *S.LEGACY_CELLS.names), S.LEGACY_CELLS).select(*S.LEGACY_CELLS.names)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return typed(S.require_columns(S.lower_columns(_read(spark, path)), "lat", "lon"), S.LOCATIONS)


def weather_sets(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Paths under root, files or partitioned folders, that are named prefix and digits, or prefix alone; in order of name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    named = re.compile(rf"{re.escape(prefix.lower())}\d*(\.parquet)?")
    return sorted(x for x in (status.getPath().toString() for status in found) if named.fullmatch(x.rpartition("/")[2].lower()))


def read_weather(spark: SparkSession, roots: str | list[str], prefix: str = "weather", resources: list[str] | None = None) -> DataFrame:
    """Hourly capacity factors of all sets of that prefix under the roots, as one table.

    A set is a folder, or a file, named prefix and digits; its columns are matched by name, and those that only some sets
    have are null elsewhere. resource is a column or a partition folder of each set, found from the set's own path; only
    folders of the asked resources are read. No set at all is an error.
    """
    sets = [s for root in ([roots] if isinstance(roots, str) else roots) for s in weather_sets(spark, root, prefix)]
    if not sets:
        raise ValueError(f"no sets named {prefix} and digits")
    scans = [S.require_columns(spark.read.option("basePath", s).parquet(s), "latitude", "longitude", "resource", "ts", "cf") for s in sets]
    both = scans[0]
    for scan in scans[1:]:
        both = both.unionByName(scan, allowMissingColumns=True)
    return typed(both.where(F.col("resource").isin(*resources)) if resources is not None else both, S.WEATHER)


def read_site_weather(spark: SparkSession, path: str) -> DataFrame:
    """One site's profiles: the first column goes, the rest are numbers; see with_defaults."""
    df = _read(spark, path)
    df = df.drop(df.columns[0])
    df = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in df.columns))
    return with_defaults(df)


def with_defaults(profiles: DataFrame) -> DataFrame:
    """Profiles with the constant ones that every plant needs: grid 0, ramp_dummy 1."""
    return profiles.withColumns({n: F.lit(v) for n, v in (("grid", 0.0), ("ramp_dummy", 1.0)) if n not in profiles.columns})


def odd_years(weather: DataFrame, *keys: str, low: int = 8700, high: int = 8808) -> DataFrame:
    """Series whose number of hours is that of no year."""
    return weather.groupBy(*keys).agg(F.count("*").alias("hours")).where((F.col("hours") < low) | (F.col("hours") > high))


def read_landcover(spark: SparkSession, path: str) -> DataFrame:
    return typed(S.require_columns(_read(spark, path), *S.LANDCOVER.names), S.LANDCOVER)


def read_bathymetry(spark: SparkSession, path: str) -> DataFrame:
    return typed(S.require_columns(_optional(spark, path, S.BATHYMETRY), *S.BATHYMETRY.names), S.BATHYMETRY)


def country_rings(features: DataFrame) -> DataFrame:
    """(country, polygon_order, part, ring, points) of GeoJSON features(feature string, polygon_order int)."""
    value = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    parsed = features.select("polygon_order", F.from_json("feature", value).alias("f"))
    country = F.coalesce(*(F.try_element_at(F.col("f.properties"), F.lit(p)) for p in COUNTRY_PROPERTIES))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", many).when(F.col("f.geometry.type") == "Polygon", F.array(one))
    rings = parsed.select(country.alias("country"), "polygon_order", F.posexplode(parts).alias("part", "rings"))
    return rings.select("country", "polygon_order", "part", F.posexplode("rings").alias("ring", "points"))


def outer_rings(features: DataFrame) -> DataFrame:
    return country_rings(features).where("ring = 0")


def country_edges(features: DataFrame) -> DataFrame:
    """Edges of all rings, holes too, numbered in each part."""
    points = country_rings(features).select("country", "polygon_order", "part", "ring", F.posexplode("points").alias("at", "p"))
    along = Window.partitionBy("polygon_order", "part", "ring").orderBy("at")
    points = points.select("country", "polygon_order", "part", "ring", "at", F.col("p")[0].alias("x1"), F.col("p")[1].alias("y1"), F.lead(F.col("p")[0]).over(along).alias("x2"), F.lead(F.col("p")[1]).over(along).alias("y2"))
    number = F.row_number().over(Window.partitionBy("polygon_order", "part").orderBy("ring", "at")) - 1
    return points.where("x2 is not null").select("country", "polygon_order", "part", number.alias("seg"), "x1", "y1", "x2", "y2")


def read_bands(spark: SparkSession, path: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """A table of places that write_bands wrote: those with low <= longitude < high; only bands that may hold some are read."""
    low, high = -180.0 if low is None else low, 180.0 if high is None else high
    bands = F.col("band").between(*(int((x + 180) // S.BAND_DEGREES) for x in (low, high)))
    return spark.read.parquet(path).where(bands & (F.col("longitude") >= low) & (F.col("longitude") < high)).drop("band")


def read_sheets(spark: SparkSession, path: str, names: list[str] | None = None, most: int = 4096) -> dict[str, DataFrame]:
    """The sheets of a detailed result that write_sheets wrote, all or those named, that have rows: their columns, numbers as
    doubles. One aggregate finds the columns of all; more than most of them are an error."""
    rows = spark.read.parquet(path)
    rows = rows if names is None else rows.where(F.col("sheet").isin(*names))
    listed = rows.select("sheet", "columns").distinct().collect()
    filled = {r.sheet for r in listed if r.columns is None}
    schemas = {r.sheet: T.StructType.fromJson(json.loads(r.columns)) for r in listed if r.columns is not None and r.sheet in filled}
    if sum(map(len, schemas.values())) > most:
        raise ValueError(f"more than {most} columns")
    sheets: dict[str, DataFrame] = {}
    for sheet, schema in sorted(schemas.items()):
        place = {"numbers": 0, "texts": 0}
        columns = []
        for f in schema:
            if f.name in S.SHEET_KEYS:
                columns.append(F.col(f.name))
                continue
            kind = "texts" if isinstance(f.dataType, T.StringType) else "numbers"
            columns.append(F.get(kind, F.lit(place[kind])).alias(f.name))
            place[kind] += 1
        sheets[sheet] = rows.where((F.col("sheet") == sheet) & F.col("columns").isNull()).select(*columns)
    return sheets


def read_sheet(spark: SparkSession, path: str, sheet: str, most: int = 4096) -> DataFrame:
    """One of read_sheets; a sheet without rows is an error."""
    found = read_sheets(spark, path, [sheet], most)
    if sheet not in found:
        raise ValueError(f"no rows in {sheet}")
    return found[sheet]


def read_segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result files in the given order, columns by name, with file_rank and row_no, a row's place in its file."""
    out = None
    for rank, path in enumerate(paths):
        part = in_file_order(_read(spark, path), "row_no").withColumn("file_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no segment files")
    return out


def read_datasheet(spark: SparkSession, path: str, year: int = 2030, estimate: str = "ctrl") -> DataFrame:
    sheet = S.require_columns(S.lower_columns(_read(spark, path)), "year", "est")
    return sheet.where((F.col("year").cast("int") == year) & (F.col("est") == estimate))
