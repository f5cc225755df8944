"""Rankings, distributions and reports of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cell_geojson, cell_id, raster_index
from ..functions.names import component_label, location_label
from ..schemas import COST_CLIP
from ..sources.folders import stored

PLACE = ("latitude", "longitude")


def clipped(results: DataFrame, limit: float = COST_CLIP) -> DataFrame:
    return results.where(F.col("lcoa_per_t") <= limit)


def clip_report(results: DataFrame, limit: float = COST_CLIP, backstop: float = 1000.0) -> DataFrame:
    """Rows, rows above the clip, rows on the backstop, and those of them inside the clip."""
    uses = F.col("grid_energy_mwh") >= backstop
    return results.agg(F.count("*").alias("rows"), F.count_if(F.col("lcoa_per_t") > limit).alias("above_clip"), F.count_if(uses).alias("on_backstop"), F.count_if(uses & (F.col("lcoa_per_t") <= limit)).alias("on_backstop_inside"))


def cheapest(results: DataFrame, n: int = 20) -> DataFrame:
    """The n cheapest places, ranked; equal costs by place."""
    top = results.where("lcoa_per_t is not null").orderBy("lcoa_per_t", *PLACE).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("lcoa_per_t", *PLACE)))


def largest(cells: DataFrame, column: str = "max_capacity_mw", n: int = 10) -> DataFrame:
    return cells.orderBy(F.col(column).desc_nulls_last(), *PLACE).limit(n)


def total_capacity(cells: DataFrame) -> DataFrame:
    """Installable capacity of all cells, by kind."""
    return cells.agg(*(F.sum(c).alias(f"total_{c}") for c in ("max_power_solar_mw", "max_power_wind_mw", "max_capacity_mw")))


def country_stats(results: DataFrame) -> DataFrame:
    """Sites of each country with their median, least and largest cost, cheapest median first. Rows are read once, to count
    values; a country without any cost has 0 sites."""
    counts = value_counts(results.where("country is not null"), "lcoa_per_t", "country")
    ends = counts.groupBy("country").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("sites"), F.min("v").alias("min_lcoa"), F.max("v").alias("max_lcoa"))
    found = ends.join(ranked(counts, {"median_lcoa": 0.5}, "country"), "country", "left")
    return found.select("country", "sites", "median_lcoa", "min_lcoa", "max_lcoa").orderBy("median_lcoa", "country")


def most_frequent(results: DataFrame, column: str = "country", n: int = 20) -> DataFrame:
    return results.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), column).limit(n)


def of_top_countries(results: DataFrame, n: int = 20) -> DataFrame:
    return results.join(most_frequent(results, n=n).select("country"), "country", "left_semi")


def _named(quantiles: tuple[float, ...]) -> dict[str, float]:
    return {f"p{round(q * 100)}": q for q in quantiles}


def describe(df: DataFrame, column: str, *by: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """count, mean, std, min, quantiles (linear between values) and max, of each group or of all rows; null is a group."""
    c, named = F.col(column), _named(quantiles)
    found = df.groupBy(*by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    ranked = quantiles_of(df, column, named, *by)
    both = _beside(found, ranked, by, "left") if by else found.crossJoin(ranked)  # without groups both are one row
    return both.select(*by, "count", "mean", "std", "min", *named, "max")


def _beside(left: DataFrame, right: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Rows of the same group next to each other; null is a group. right's group columns go."""
    own = {c: f"__{c}" for c in by}
    right = right.withColumnsRenamed(own)
    same = [left[c].eqNullSafe(right[o]) for c, o in own.items()]
    return left.join(right, same, how).drop(*own.values())


def value_counts(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, v, n): how often each value is there in each group; NaN counts as null. Stored, as ranking reads it several times."""
    v = F.col(column).cast("double")
    return stored(df.select(*by, F.when(~F.isnan(v), v).alias("v")).groupBy(*by, "v").agg(F.count("*").alias("n")), "counts")


def quantiles_of(df: DataFrame, column: str, named: dict[str, float], *by: str, pieces: int = 1024, cuts: int = 2) -> DataFrame:
    """Exact quantiles, linear between values, of each group, however many of the rows it holds; see ranked."""
    return ranked(value_counts(df, column, *by), named, *by, pieces=pieces, cuts=cuts)


def ranked(counts: DataFrame, named: dict[str, float], *by: str, pieces: int = 1024, cuts: int = 2) -> DataFrame:
    """(by, a column for each name) of counts(by, v, n): the values at the wanted ranks; nulls have no rank, and a group
    of nulls has no row.

    The range from a group's least to its largest value is cut in equal pieces, values are counted by piece, and the
    pieces that hold a wanted rank are cut again. Only values of the pieces found last are ordered, each piece by itself,
    so that a group is as many tasks as it has values for. Without groups there is one row, of nulls if nothing is counted.
    """
    counts = counts.where("v is not null")
    ends = counts.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("rows"))
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, q in named.items() for p in [F.lit(q) * (F.col("rows") - 1)] for r in (F.floor(p), F.ceil(p))))
    parts = ends.select(*by, "low", "high", "rows", F.lit(0).cast("long").alias("start"), wanted.alias("wanted"))
    for _ in range(cuts):
        inside = _in_parts(counts, parts, by)
        width = F.coalesce(F.try_divide((F.col("v") - F.col("low")) * pieces, F.col("high") - F.col("low")), F.lit(0.0))
        key = [*by, "low", "high", "rows", "start", "wanted"]
        sums = inside.withColumn("piece", F.least(F.lit(pieces - 1), F.floor(width))).groupBy(*key, "piece").agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy(*by, "low").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
        sums = sums.withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        own = F.filter("wanted", lambda w: (w["rank"] >= F.col("start")) & (w["rank"] < F.col("start") + F.col("n")))
        parts = sums.select(*by, F.col("least").alias("low"), F.col("most").alias("high"), "rows", "start", own.alias("wanted")).where(F.size("wanted") > 0)
    within = Window.partitionBy(*by, "low").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = _in_parts(counts, parts, by).withColumn("upto", F.col("start") + F.sum("n").over(within))
    found = kept.select(*by, "v", "rows", F.explode(F.filter("wanted", lambda w: (w["rank"] < F.col("upto")) & (w["rank"] >= F.col("upto") - F.col("n")))).alias("w"))
    share = lambda q: F.lit(q) * (F.max("rows") - 1) - F.floor(F.lit(q) * (F.max("rows") - 1))
    of = lambda k, f: f(F.when(F.col("w.name") == k, F.col("v")))
    return found.groupBy(*by).agg(*((of(k, F.min) + (of(k, F.max) - of(k, F.min)) * share(q)).alias(k) for k, q in named.items()))


def _in_parts(counts: DataFrame, parts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """counts with the part, of a group's range of values, that each lies in; values in none go. A group has few parts."""
    listed = parts.groupBy(*by).agg(F.collect_list(F.struct("low", "high", "rows", "start", "wanted")).alias("parts"))
    both = _beside(counts, listed, by) if by else counts.crossJoin(listed)  # one row
    return both.select(*by, "v", "n", F.inline(F.filter("parts", lambda p: F.col("v").between(p["low"], p["high"]))))


def quantile_row(df: DataFrame, column: str, named: dict[str, float]) -> DataFrame:
    """One row of exact quantiles of all rows; nulls and NaN don't count; no rows give nulls."""
    return quantiles_of(df, column, named)


def clip_quantiles(df: DataFrame, column: str = "lcoa_per_t", low: float = 0.02, high: float = 0.98) -> DataFrame:
    return quantile_row(df, column, {"low": low, "high": high})


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, rows) of equal bins from the least to the largest value, which is in the last one."""
    ends = df.agg(F.min(column).alias("least"), F.max(column).alias("most"))
    both = df.where(F.col(column).isNotNull()).crossJoin(ends)  # ends is one row
    width = (F.col("most") - F.col("least")) / bins
    place = F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("least"), width), F.lit(0.0))) + 1)
    counted = both.groupBy(place.cast("int").alias("bin"), "least", "most").agg(F.count("*").alias("rows"))
    return counted.select("bin", (F.col("least") + (F.col("bin") - 1) * width).alias("low"), (F.col("least") + F.col("bin") * width).alias("high"), "rows")


def box_stats(df: DataFrame, by: str, column: str = "lcoa_per_t") -> DataFrame:
    """Quartiles by group, and the outermost values within one and a half times their distance. Rows are read once, to count
    values; rows without a group don't count."""
    counts = value_counts(df.where(F.col(by).isNotNull()), column, by)
    q = ranked(counts, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = counts.join(q, by).where(F.col("v").between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(by).agg(F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), F.min("v").alias("low"), F.max("v").alias("high"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of the columns that have any, most first."""
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return row.unpivot([], df.columns, "column", "nulls").where("nulls > 0").orderBy(F.col("nulls").desc(), "column")


def component_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).unpivot([], columns, "component", "value").groupBy("component").agg(F.avg("value").alias("mean"))


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.count_distinct(c).alias(c) for c in columns))


def cost_ranges(spatial: DataFrame, cells: DataFrame) -> DataFrame:
    """Ranges of the spatial costs, and how many places are on land and at sea."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("water_cost_usd_per_m3", "build_cost_multiplier", "land_cost_usd_per_km2_year") for n, f in (("min", F.min), ("max", F.max))]
    places = cells.agg(F.count_if(F.col("onshore_land_pct") > 0).alias("onshore"), F.count_if(F.col("onshore_land_pct") == 0).alias("offshore"))
    return spatial.agg(*ends, F.count_distinct("tech").alias("techs")).crossJoin(places)


def offshore_multipliers(costs: DataFrame, cells: DataFrame) -> DataFrame:
    """Multipliers by technology, at sea and on land."""
    both = costs.join(cells.select("cell_id", (F.col("onshore_land_pct") == 0).alias("offshore")), "cell_id")
    m = F.col("build_cost_multiplier")
    return both.groupBy("tech", "offshore").agg(F.count("*").alias("rows"), F.avg(m).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max"))


def depth_ends(costs: DataFrame, cells: DataFrame, n: int = 5) -> DataFrame:
    """The shallowest and the deepest offshore rows, with their depths."""
    both = costs.join(cells.where("onshore_land_pct = 0").select("cell_id", "bathymetry_depth_m"), "cell_id")
    return both.orderBy("bathymetry_depth_m", "cell_id", "tech").limit(n).unionByName(both.orderBy(F.col("bathymetry_depth_m").desc(), "cell_id", "tech").limit(n))


def coverage(cells: DataFrame, results: DataFrame) -> DataFrame:
    """Places with capacity, solved and missing, with and without a country; of several countries of a place the first."""
    land = cells.where("max_capacity_mw > 0").select(*PLACE).distinct()
    solved = results.groupBy(*PLACE).agg(F.min("country").alias("country"))
    found = land.join(solved.withColumn("solved", F.lit(True)), list(PLACE), "left")
    counts = found.agg(F.count("*").alias("land_cells"), F.count("solved").alias("solved"), F.count("country").alias("with_country"))
    counts = counts.withColumns({"missing": F.col("land_cells") - F.col("solved"), "without_country": F.col("solved") - F.col("with_country")})
    return counts.withColumn("solved_pct", F.try_divide(F.col("solved") * 100.0, F.col("land_cells")))


def extent(df: DataFrame, half: float = 0.5, margin: float = 0.1) -> DataFrame:
    return df.agg(*((f(c) + sign * (half + margin)).alias(f"{n}_{c}") for c in PLACE for n, f, sign in (("min", F.min, -1), ("max", F.max, 1))))


def top_components(results: DataFrame, columns: list[str], n: int = 15) -> DataFrame:
    """(rank, location, component, value) of the n cheapest places."""
    top = cheapest(results, n)
    named = top.select("rank", location_label(F.col("country"), F.col("latitude"), F.col("longitude")).alias("location"), *columns)
    return named.unpivot(["rank", "location"], columns, "component", "value").withColumn("component", component_label(F.col("component")))


def map_feed(results: DataFrame) -> DataFrame:
    """(cell, geojson, value, low, high): a colour for each cell, clipped to the middle of the distribution."""
    known = results.where("lcoa_per_t is not null")
    return known.crossJoin(clip_quantiles(known)).select(cell_id(F.col("latitude"), F.col("longitude")).alias("cell"), cell_geojson(F.col("latitude"), F.col("longitude")).alias("geojson"), F.greatest("low", F.least("high", "lcoa_per_t")).alias("value"), "low", "high")


def scatter_feed(results: DataFrame, x: str, y: str) -> DataFrame:
    return results.select(*PLACE, F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])


def raster(df: DataFrame, value: Column, size: float = 1.0) -> DataFrame:
    ends = df.agg(F.min("latitude").alias("south"), F.min("longitude").alias("west"))
    both = df.crossJoin(ends)  # ends is one row
    return both.select(raster_index(F.col("latitude"), F.col("south"), size).alias("row"), raster_index(F.col("longitude"), F.col("west"), size).alias("col"), value.alias("value"))
