"""Technology costs: compiled plant costs, spatial inputs, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import annual_cost, depth_multiplier, effective_depth, store_scale, to_input_basis
from ..functions.names import normalize_name
from ..functions.recipes import differing_keys, extra_keys, first_efficiency, overall_efficiency, recipe_per_output, second_efficiency
from ..schemas import DEFAULT_LIFETIME, DEFAULT_OM, DEFAULT_RATE, DEFAULT_WATER_M3_PER_T, RATE_ALIASES
from ..sources.folders import stored
from .lookup import merged_within, place_key


def _or(name: str, value: float):
    return F.coalesce(F.col(name), F.lit(value))


def unmatched(techs: DataFrame, plant: DataFrame) -> DataFrame:
    """Technologies without a plant component; has to be empty before costs are compiled."""
    return techs.join(plant.select(F.col("name").alias("tech")), "tech", "left_anti")


def base_costs(techs: DataFrame, time_step: float = 1.0, aggregation: int = 1) -> DataFrame:
    """techs(tech, component_type, overnight, lifetime, rate, om, eff, ...) with capital_cost: annual, links per input,
    stores scaled by the length of a snapshot."""
    annual = annual_cost(F.col("overnight"), _or("rate", DEFAULT_RATE), _or("lifetime", DEFAULT_LIFETIME), _or("om", DEFAULT_OM))
    kind, scale = F.col("component_type"), store_scale(time_step, aggregation)
    cost = F.when(kind == "link", to_input_basis(annual, F.coalesce("eff", F.lit(1.0)))).when(kind == "store", annual * scale).otherwise(annual)
    return techs.withColumn("capital_cost", cost)


def link_coefficients(techs: DataFrame, links: DataFrame) -> DataFrame:
    """efficiency and efficiency2 of links from recipes(carriers_in, carriers_out) and their buses."""
    both = techs.join(links.select(F.col("name").alias("tech"), "bus0", "bus1", "bus2"), "tech")
    arguments = [F.col(c) for c in ("carriers_in", "carriers_out", "bus0")]
    return both.withColumns({"efficiency": first_efficiency(*arguments, F.col("bus1")), "efficiency2": second_efficiency(*arguments, F.col("bus2"))})


def compile_costs(techs: DataFrame, links: DataFrame, time_step: float = 1.0, aggregation: int = 1) -> DataFrame:
    """(tech, component_type, efficiency, efficiency2, standing_loss, annual_cost, capital_cost, overall_efficiency): what a
    plant's tables take from techs, and the summary.

    A link with a recipe gets its coefficients from it, else it keeps the plant's. Its cost is per output, and
    capital_cost per input. A link that isn't in the plant, a recipe without a bus of the link, with an amount that isn't
    positive, and a link with a second bus but no recipe are errors.
    """
    plant = links.select(F.col("name").alias("tech"), "bus0", "bus1", "bus2", F.col("efficiency").alias("plant_efficiency"), F.col("efficiency2").alias("plant_efficiency2"))
    both = techs.join(plant, "tech", "left")
    error = lambda text: F.raise_error(F.concat(F.col("tech"), F.lit(f": {text}"))).cast("double")
    is_link, recipe = F.col("component_type") == "link", F.col("carriers_in").isNotNull() & F.col("carriers_out").isNotNull()
    second = F.coalesce(~F.lower(F.trim("bus2")).isin("", "nan"), F.lit(False))
    taken, made = F.try_element_at("carriers_in", F.col("bus0")), F.try_element_at("carriers_out", F.col("bus1"))
    first = first_efficiency(*(F.col(c) for c in ("carriers_in", "carriers_out", "bus0", "bus1")))
    first = F.when((taken > 0) & (made > 0), first).otherwise(error("the recipe lacks a positive amount of the link's first two buses"))
    first = F.when(F.col("bus0").isNull(), error("no such link in the plant")).when(recipe, first).otherwise(F.col("plant_efficiency"))
    other = F.coalesce(second_efficiency(*(F.col(c) for c in ("carriers_in", "carriers_out", "bus0", "bus2"))), error("the recipe lacks the link's third bus"))
    other = F.when(~second, F.col("plant_efficiency2")).when(recipe, other).otherwise(error("a link with a third bus needs a recipe"))
    both = both.withColumns({"efficiency": F.when(is_link, first), "efficiency2": F.when(is_link, other)})
    annual = annual_cost(F.col("overnight"), _or("rate", DEFAULT_RATE), _or("lifetime", DEFAULT_LIFETIME), _or("om", DEFAULT_OM))
    cost = F.when(is_link, to_input_basis(annual, F.col("efficiency"))).when(F.col("component_type") == "store", annual * store_scale(time_step, aggregation)).otherwise(annual)
    loss = F.when((F.col("component_type") == "store") & (F.col("standing_loss") > 0), F.col("standing_loss"))
    ins, outs = recipe_per_output(*(F.col(c) for c in ("bus0", "bus1", "bus2", "efficiency", "efficiency2")))
    overall = F.when(is_link & recipe, overall_efficiency(ins, outs))
    return both.select("tech", "component_type", "efficiency", "efficiency2", loss.alias("standing_loss"), annual.alias("annual_cost"), cost.alias("capital_cost"), overall.alias("overall_efficiency"))


def check_recipes(techs: DataFrame, links: DataFrame, tolerance: float = 1e-3, efficiency_tolerance: float = 2e-2) -> DataFrame:
    """(tech, problem, detail): ports of a recipe that the plant's coefficients don't have, and the other way round; amounts
    that differ; an overall efficiency that differs from outputs over inputs."""
    both = techs.join(links.select(F.col("name").alias("tech"), "bus0", "bus1", "bus2", "efficiency", "efficiency2"), "tech")
    ins, outs = recipe_per_output(*(F.col(c) for c in ("bus0", "bus1", "bus2", "efficiency", "efficiency2")))
    both = both.withColumns({"plant_in": ins, "plant_out": outs})
    cases = []
    for side in ("in", "out"):
        ours, plant = F.col(f"carriers_{side}"), F.col(f"plant_{side}")
        cases += [(f"extra {side}", extra_keys(ours, plant)), (f"missing {side}", extra_keys(plant, ours)), (f"amount {side}", differing_keys(ours, plant, tolerance))]
    off = F.abs(F.col("overall_efficiency") - overall_efficiency(F.col("carriers_in"), F.col("carriers_out"))) > efficiency_tolerance
    cases.append(("efficiency", F.when(off, F.array(F.lit("overall_efficiency"))).otherwise(F.array().cast("array<string>"))))

    def named(problem: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(problem).alias("problem"), k.alias("detail")))

    rows = F.flatten(F.array(*(named(*case) for case in cases)))
    return both.select("tech", F.inline(rows))


def check_cost_split(techs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Technologies whose two parts don't add up to the overnight cost."""
    gap = F.col("tech_cost") + F.col("build_cost") - F.col("overnight")
    return techs.select("tech", gap.alias("gap")).where(F.abs("gap") > tolerance)


def derive_cost_split(parts: DataFrame, buckets: DataFrame, power_share: float = 0.5) -> DataFrame:
    """(tech, bucket, cost, per_mw, per_mwh) from parts(tech, part, percent, cost): parts fall into buckets, and a cost
    that belongs to power and energy both is divided between them."""
    found = parts.join(buckets, "part").groupBy("tech", "bucket").agg(F.sum(F.col("cost") * F.col("percent") / 100).alias("cost"))
    return found.withColumns({"per_mw": F.col("cost") * power_share, "per_mwh": F.col("cost") * (1 - power_share)})


def build_spatial_costs(cells: DataFrame, techs: DataFrame) -> DataFrame:
    """(cell_id, lat, lon, tech, interest_rate, build_cost_multiplier): every place with capacity times every technology
    with a rate. techs is a table of technologies, whose size doesn't follow the cells, so the product grows with the
    cells alone."""
    cells = cells.where(F.col("max_capacity_mw") > 0).withColumn("depth", effective_depth(F.col("onshore_land_pct"), F.col("bathymetry_depth_m")))
    both = cells.crossJoin(techs.where(F.col("rate").isNotNull()).select("tech", "rate"))
    return both.select("cell_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "tech", F.col("rate").alias("interest_rate"), depth_multiplier(F.col("depth"), F.col("tech")).alias("build_cost_multiplier"))


def override_source(kind: str, spatial: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """The overrides that a run uses: none, the spatial table, or a table of one's own."""
    if kind not in ("none", "spatial", "custom"):
        raise ValueError(f"unknown source of overrides: {kind}")
    if kind == "custom" and custom is None:
        raise ValueError("custom overrides need a table")
    return {"none": spatial.limit(0), "spatial": spatial, "custom": custom}[kind]


def tech_overrides(spatial: DataFrame) -> DataFrame:
    """The last value in file order of each parameter, by cell and technology."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("file_order"))).alias(c)
    return spatial.groupBy("cell_id", "tech").agg(last("interest_rate"), last("build_cost_multiplier"))


def location_overrides(spatial: DataFrame) -> DataFrame:
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("file_order"))).alias(c)
    return spatial.groupBy("cell_id").agg(last("land_cost_usd_per_km2_year"), last("water_cost_usd_per_m3"))


def both_overrides(spatial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tech_overrides and location_overrides of a table that is read once: what a cell's technologies have last, with its
    order, is stored, and a cell's own values are the last of these."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("file_order"))
    own, whole = ("interest_rate", "build_cost_multiplier"), {"land_cost_usd_per_km2_year": "land_order", "water_cost_usd_per_m3": "water_order"}
    values = [F.max_by(c, at(c)).alias(c) for c in (*own, *whole)]
    last = stored(spatial.groupBy("cell_id", "tech").agg(*values, *(F.max(at(c)).alias(o) for c, o in whole.items())), "overrides")
    return last.select("cell_id", "tech", *own), last.groupBy("cell_id").agg(*(F.max_by(c, o).alias(c) for c, o in whole.items()))


def place_overrides(cells: DataFrame, spatial: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(cell_id, tech, interest_rate, build_cost_multiplier) for cells(cell_id, latitude, longitude): the last values in file
    order at the cell's place, to four decimals; with a tolerance, cells without any take those of rows so near."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("file_order"))).alias(c)
    key, values = ["key_lat", "key_lon"], ["interest_rate", "build_cost_multiplier"]
    at = spatial.select(*place_key(F.col("latitude"), F.col("longitude")), "tech", *values, "file_order").groupBy(*key, "tech").agg(*map(last, values))
    probe = cells.select("cell_id", "latitude", "longitude", *place_key(F.col("latitude"), F.col("longitude")))
    found = probe.join(at, key).select("cell_id", "tech", *values)
    if tolerance is None:
        return found
    rest = probe.join(at.select(*key).distinct(), key, "left_anti").select(F.col("cell_id").alias("id"), "latitude", "longitude")
    return found.unionByName(merged_within(rest, spatial, ["tech"], values, tolerance=tolerance).withColumnRenamed("id", "cell_id"))


def apply_overrides(techs: DataFrame, overrides: DataFrame, time_step: float = 1.0, aggregation: int = 1) -> DataFrame:
    """(cell_id, tech, capital_cost) of each cell and technology with a rate of its own: the multiplier goes to the build
    part, or to the whole where a technology isn't split."""
    own = overrides.where(F.col("interest_rate").isNotNull()).withColumn("tech", normalize_name(F.col("tech"))).join(techs, "tech")
    multiplier = F.coalesce("build_cost_multiplier", F.lit(1.0))
    split = F.col("tech_cost").isNotNull() & F.col("build_cost").isNotNull()
    overnight = F.when(split, F.col("tech_cost") + F.col("build_cost") * multiplier).otherwise(F.col("overnight") * multiplier)
    own = own.where(F.col("overnight").isNotNull()).withColumns({"overnight": overnight, "rate": F.col("interest_rate")})
    return base_costs(own, time_step, aggregation).select("cell_id", "tech", "interest_rate", "capital_cost")


def scenario_overrides(components: DataFrame, overrides: DataFrame) -> DataFrame:
    """components(name, component_type, capital_cost, efficiency, output_rated) with a scenario's own costs and
    efficiencies; a link that is rated on its output takes its cost per output."""
    both = components.join(overrides.select("name", F.col("capital_cost").alias("new_cost"), F.col("efficiency").alias("new_efficiency")), "name", "left")
    efficiency = F.coalesce("new_efficiency", "efficiency")
    cost = F.when((F.col("component_type") == "link") & F.col("output_rated"), F.col("new_cost") * efficiency).otherwise(F.col("new_cost"))
    return both.select("name", "component_type", F.coalesce(cost, "capital_cost").alias("capital_cost"), efficiency.alias("efficiency"))


def interest_rates(overrides: DataFrame) -> DataFrame:
    """A row per cell with interest_rate_<name> columns, by today's names and report aliases."""
    names = F.create_map(*(F.lit(x) for pair in RATE_ALIASES.items() for x in pair))
    tech = normalize_name(F.col("tech"))
    long = overrides.where(F.col("interest_rate").isNotNull()).select("cell_id", F.concat(F.lit("interest_rate_"), F.coalesce(F.try_element_at(names, tech), tech)).alias("column"), "interest_rate")
    return long.groupBy("cell_id").pivot("column").agg(F.max("interest_rate"))


def location_costs(cells: DataFrame, overrides: DataFrame, meta: DataFrame) -> DataFrame:
    """Water and land cost of each cell: water the cell's own, else the scenario's; land the cell's own only. meta has
    one row, that of the scenario; any other number of rows is an error."""
    one = meta.agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("water_cost_baseline_usd_per_m3", "water_usage_m3_per_t_nh3")))
    one = one.where(F.when(F.col("rows") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("meta has to have one row")).cast("boolean"))).drop("rows")
    both = cells.join(overrides, "cell_id", "left").crossJoin(one)
    water, usage = F.coalesce("water_cost_usd_per_m3", "water_cost_baseline_usd_per_m3"), F.coalesce("water_usage_m3_per_t_nh3", F.lit(DEFAULT_WATER_M3_PER_T))
    return both.select("cell_id", "land_cost_usd_per_km2_year", water.alias("water_cost_usd_per_m3"), usage.alias("water_usage_m3_per_t_nh3"), (water * usage).alias("water_cost_per_t"))
