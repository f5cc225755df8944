"""Result tables: segments, order of columns, retries, detailed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.costs import ammonia_t_per_h, hydrogen_t_per_h, output_capacity
from ..schemas import AMMONIA_MWH_PER_T, COST_COMPONENTS, HOURS_PER_YEAR

#: The first columns of a result, in the order of a report.
HEADLINE = (
    "latitude",
    "longitude",
    "country",
    "currency",
    "lcoa_per_t",
    "lcoa_all_in_per_t",
    "annual_ammonia_demand_mwh",
    "annual_ammonia_production_t",
    "total_cost",
    "build_cost_pct",
    "tech_cost_pct",
    "om_cost_pct",
    "interest_pct",
    "water_cost_pct",
    "land_cost_pct",
)
#: Its columns of land and water, in the same order.
LAND = (
    "land_onshore_pct",
    "offshore_sea_pct",
    "land_cell_area_km2",
    "onshore_area_km2",
    "offshore_area_km2",
    "bathymetry_depth_m",
    "area_cap_mw",
    "solar_area_used_km2",
    "wind_area_used_km2",
    "land_used_km2",
    "land_cost_per_t",
    "water_cost_per_t",
)

#: Rows of a series that a task makes a wide table of, about; it holds and sorts these in memory.
TASK_ROWS = 1 << 20


def combine_segments(rows: DataFrame, keys: tuple[str, ...] = ("latitude", "longitude")) -> DataFrame:
    """The last row of each place, by file_rank and then row_no."""
    order = Window.partitionBy(*keys).orderBy(F.col("file_rank").desc(), F.col("row_no").desc())
    return rows.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def retry_list(requested: DataFrame, results: DataFrame) -> DataFrame:
    """Requested places without a result."""
    return requested.select("latitude", "longitude").distinct().join(results.select("latitude", "longitude"), ["latitude", "longitude"], "left_anti")


def order_columns(results: DataFrame) -> DataFrame:
    """Headline, land and water, capacities, cost components, rates, then the rest."""
    have = results.columns
    first = [c for c in (*HEADLINE, *LAND) if c in have]
    groups = (lambda c: c.endswith(("_mw", "_mwh", "_capacity_t")), lambda c: c.startswith(("lcoa_component_", "cost_share_", "other_cost", "capital_cost_share")), lambda c: c.startswith("interest_rate"))
    for belongs in groups:
        first += [c for c in have if c not in first and belongs(c)]
    return results.select(*first, *(c for c in have if c not in first))


def backfill_currency(results: DataFrame, currency: str) -> DataFrame:
    """Cost columns of old results under the neutral names."""
    have = lambda *names: [F.col(n) for n in names if n in results.columns]
    slug = currency.strip().lower()
    for name in ("lcoa{}_per_t", "total_cost{}_per_year"):
        neutral = name.format("")
        if found := have(neutral, name.format(f"_{slug}"), name.format("_currency"), name.format("_usd")):
            results = results.withColumn(neutral, F.coalesce(*found))
    return results.withColumn("currency", F.coalesce(*have("currency"), F.lit(currency.strip().upper())))


def assemble(parts: list[DataFrame], cells: DataFrame) -> DataFrame:
    """One wide row for each solved cell: the parts, all by cell_id, beside the cells' own columns."""
    wide = cells
    for part in parts:
        wide = wide.join(part, "cell_id", "left")
    return order_columns(wide)


def preflight(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """(table, missing, rows): what the inputs of a run lack, before the run and by a scan of each."""
    reports = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit(", ".join(c for c in needed if c not in df.columns)).alias("missing"), "rows") for name, (df, needed) in tables.items()]
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


class Preflight:
    """What the inputs of a run lack, seen while the run reads them: watch() gives a table to use in place of one's own,
    report() has a row for each after the run. No table is read for the report alone."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple[str, Observation]] = {}

    def watch(self, name: str, df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
        missing = ", ".join(c for c in needed if c not in df.columns)
        present = [c for c in needed if c in df.columns]
        self.seen[name] = missing, Observation()
        nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{k}") for k, c in enumerate(present)]
        return df.observe(self.seen[name][1], F.count(F.lit(1)).alias("rows"), *nulls)

    def report(self, spark: SparkSession) -> DataFrame:
        """(table, missing, rows, nulls): columns that are missing, rows that were read, and nulls in needed columns."""
        rows = []
        for name, (missing, seen) in self.seen.items():
            got = seen.get
            rows.append((name, missing, got["rows"], sum(v for k, v in got.items() if k != "rows")))
        return spark.createDataFrame(rows, "table string, missing string, rows long, nulls long").coalesce(1)


def timeline(dispatch: DataFrame) -> DataFrame:
    """A row per cell and snapshot: generation above 0, the process's demand below."""
    of = lambda n, sign: F.sum(F.when(F.col("name") == n, F.col("p") * sign)).alias(n)
    return dispatch.groupBy("cell_id", "ts").agg(of("wind", 1.0), of("solar", 1.0), of("ammonia_synthesis", -1.0))


def pivoted(series: DataFrame, value: str, scale: float = 1.0, most: int = 256) -> DataFrame:
    """(cell_id, ts, a column for each name) of series(cell_id, name, ts, value): sums, times scale.

    Names are found by one aggregate, whose result is as long as there are components in a plant; more than most are an
    error, as that is no table to read. A name without a row at a snapshot is null there. The aggregate counts the rows too:
    as many tasks are made as they need.
    """
    found = series.groupBy("name").count().orderBy("name").limit(most + 2).collect()
    names, rows = [r.name for r in found if r.name is not None], sum(r["count"] for r in found)
    if len(names) > most:
        raise ValueError(f"more than {most} components")
    if not names:
        return series.select("cell_id", "ts").limit(0)
    sums = [(F.sum(F.when(F.col("name") == n, F.col(value))) * scale).alias(n) for n in sorted(names)]
    tasks = max(series.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return series.repartition(tasks, "cell_id", "ts").groupBy("cell_id", "ts").agg(*sums)


def generation(dispatch: DataFrame, generators: DataFrame, scale: float = 1.0) -> DataFrame:
    """Power of all generators(name) by cell and snapshot, a column for each that has any."""
    return pivoted(dispatch.join(generators.select("name").distinct(), "name", "left_semi"), "p", scale)


def stored_energy(levels: DataFrame, scale: float = 1.0, aggregation: int = 1, time_step: float = 1.0) -> DataFrame:
    """Energy in all stores by cell and snapshot, a column for each, from levels(cell_id, name, ts, e). A level counts
    snapshots; each stands for aggregation times time_step hours."""
    return pivoted(levels, "e", scale * aggregation * time_step)


def detailed_sheets(
    capacity: DataFrame, dispatch: DataFrame, levels: DataFrame, flows: tuple[DataFrame, DataFrame], techs: DataFrame, links: DataFrame, objective: DataFrame, load_mw: float,
    fuel_cell_efficiency: float, scale: float = 1.0, aggregation: int = 1, time_step: float = 1.0, operating: bool = False,
) -> dict[str, DataFrame]:
    """The seven tables of a detailed result by cell: headlines, generators, components, stores, generation, consumption
    and stored energy.

    techs(name, component_type) tells kinds apart; links has what rated_components needs; flows are consumption's;
    objective(cell_id, objective) is the cost of a year. A run with fixed capacity has its production for a headline.
    """
    kind = lambda k: techs.where(F.col("component_type") == k).select("name")
    production = load_mw / AMMONIA_MWH_PER_T * HOURS_PER_YEAR
    headlines = operating_headline(levels.where("name = 'ammonia'")) if operating else objective.select("cell_id", (F.col("objective") / production).alias("cost_per_t"), F.lit(production * scale).alias("production_t_per_year"))
    generators = capacity.join(kind("generator"), "name", "left_semi").select("cell_id", "name", (F.col("optimum") * scale).alias("rated_mw"))
    return {
        "headlines": headlines,
        "generators": generators,
        "components": rated_components(capacity, links, scale),
        "stores": scaled_stores(capacity, kind("store"), scale, aggregation * time_step),
        "generation": generation(dispatch, kind("generator"), scale),
        "consumption": consumption(*flows, fuel_cell_efficiency, scale),
        "stored_energy": stored_energy(levels, scale, aggregation, time_step),
    }


def rated_components(capacity: DataFrame, links: DataFrame, scale: float = 1.0) -> DataFrame:
    both = capacity.join(links.select("name", "carrier", "bus0", "bus2", "efficiency"), "name")
    return both.select("cell_id", "name", (output_capacity(F.col("optimum"), F.col("efficiency")) * scale).alias("rated_mw"), "carrier", F.col("bus0").alias("primary_source"), F.col("bus2").alias("secondary_source"))


def scaled_stores(capacity: DataFrame, stores: DataFrame, scale: float = 1.0, store_scale: float = 1.0) -> DataFrame:
    return capacity.join(stores.select("name"), "name", "left_semi").select("cell_id", "name", (F.col("optimum") * scale * store_scale).alias("storage_mwh"))


def consumption(primary: DataFrame, secondary: DataFrame, fuel_cell_efficiency: float, scale: float = 1.0) -> DataFrame:
    """Flows by cell and snapshot in units that are read: hydrogen in tonnes an hour, with ammonia made of it."""
    of = lambda n: F.sum(F.when(F.col("name") == n, F.col("p") * scale))
    first = primary.groupBy("cell_id", "ts").agg(
        of("electrolysis").alias("electrolysis_mw"),
        hydrogen_t_per_h(of("hydrogen_compression")).alias("hydrogen_to_storage_t_per_h"),
        hydrogen_t_per_h(of("hydrogen_from_storage")).alias("hydrogen_from_storage_t_per_h"),
        of("battery_pcs_charge").alias("battery_charge_mw"),
        of("battery_pcs_discharge").alias("battery_discharge_mw"),
        (of("hydrogen_fuel_cell") * fuel_cell_efficiency).alias("fuel_cell_mw"),
        of("ammonia_synthesis").alias("synthesis_power_mw"),
    )
    second = secondary.groupBy("cell_id", "ts").agg(of("hydrogen_compression").alias("compression_power_mw"), hydrogen_t_per_h(of("ammonia_synthesis")).alias("synthesis_hydrogen_t_per_h"))
    return first.join(second, ["cell_id", "ts"]).withColumn("ammonia_t_per_h", ammonia_t_per_h(F.col("synthesis_hydrogen_t_per_h")))


def operating_headline(levels: DataFrame, hours_per_year: int = HOURS_PER_YEAR) -> DataFrame:
    """(cell_id, production_mt_per_year) of a run with fixed capacity: the last level of the ammonia store, by year."""
    ended = levels.groupBy("cell_id").agg(F.max_by("e", "ts").alias("e"), F.count("*").alias("n"))
    return ended.select("cell_id", (F.col("e") / AMMONIA_MWH_PER_T * 1e-6 / (F.col("n") / hours_per_year)).alias("production_mt_per_year"))


def rescale(rows: DataFrame, columns: list[str], factor: float) -> DataFrame:
    return rows.withColumns({c: F.col(c) * F.lit(factor) for c in columns})


def site_headline(row: DataFrame) -> DataFrame:
    """Nine figures of one site; the cost falls back to the usd column."""
    costs = [F.col(c) for c in ("lcoa_per_t", "lcoa_usd_per_t") if c in row.columns]
    wanted = ("annual_ammonia_production_t", "total_cost", "wind", "solar", "electrolysis", "ammonia_synthesis", "hydrogen_storage_capacity", "grid_energy_mwh")
    return row.select(F.coalesce(*costs).alias("lcoa_per_t"), *(F.col(c) if c in row.columns else F.lit(None).cast("double").alias(c) for c in wanted))


def component_columns() -> list[str]:
    return [*(f"lcoa_component_{label}_per_t" for label, _, _ in COST_COMPONENTS), "lcoa_component_other_per_t"]
