"""What solved designs cost, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import capital_recovery, output_capacity
from ..schemas import AMMONIA_MWH_PER_T, COST_COMPONENTS, DEFAULT_LIFETIME, DEFAULT_OM, DEFAULT_RATE, HOURS_PER_YEAR, HYDROGEN_MWH_PER_T


def dispatch_cost(dispatch: DataFrame, weights: DataFrame, marginal: DataFrame) -> DataFrame:
    """(cell_id, name, opex): flow times the snapshot's weight times the marginal cost."""
    both = dispatch.join(weights, "ts").join(marginal, "name")
    return both.groupBy("cell_id", "name").agg(F.sum(F.col("p") * F.col("weight") * F.col("marginal_cost")).alias("opex"))


def annual_energy(dispatch: DataFrame, names: list[str], time_step: float = 1.0) -> DataFrame:
    """(cell_id, <name>_mwh ...): energy through components; one that is absent has 0."""
    sums = [(F.coalesce(F.sum(F.when(F.col("name") == n, F.col("p"))), F.lit(0.0)) * time_step).alias(f"{n}_mwh") for n in names]
    return dispatch.groupBy("cell_id").agg(*sums)


def capex(capacity: DataFrame, costs: DataFrame) -> DataFrame:
    """(cell_id, name, capex) of solved capacity(cell_id, name, optimum); what isn't known counts as 0."""
    both = capacity.join(costs.select("name", "capital_cost"), "name", "left")
    return both.select("cell_id", "name", (F.coalesce("capital_cost", F.lit(0.0)) * F.coalesce("optimum", F.lit(0.0))).alias("capex"))


def cost_breakdown(capex_rows: DataFrame, opex_rows: DataFrame, objective: DataFrame) -> DataFrame:
    """(cell_id, total_cost, total_capital, <label>_cost ..., other_cost): nine components and the rest of the objective."""
    both = capex_rows.select("cell_id", "name", "capex", F.lit(0.0).alias("opex")).unionByName(opex_rows.select("cell_id", "name", F.lit(0.0).alias("capex"), "opex"))
    cost = F.coalesce("capex", F.lit(0.0)) + F.coalesce("opex", F.lit(0.0))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, cost)), F.lit(0.0))
    wide = both.groupBy("cell_id").agg(F.sum("capex").alias("total_capital"), *(of(name).alias(f"{label}_cost") for label, _, name in COST_COMPONENTS))
    wide = objective.select("cell_id", F.col("objective").alias("total_cost")).join(wide, "cell_id")
    tracked = sum((F.col(f"{label}_cost") for label, _, _ in COST_COMPONENTS), F.lit(0.0))
    return wide.withColumn("other_cost", F.col("total_cost") - tracked)


def lcoa(breakdown: DataFrame, load_mw: float, hours: int = HOURS_PER_YEAR) -> DataFrame:
    """Cost per tonne, shares and parts of it; what would be divided by 0 is null; a negative rest counts as 0."""
    production = load_mw / AMMONIA_MWH_PER_T * hours
    total, made = F.col("total_cost"), F.lit(production)
    rest = F.greatest("other_cost", F.lit(0.0))
    columns = {"annual_ammonia_demand_mwh": F.lit(load_mw * hours), "annual_ammonia_production_t": made, "lcoa_per_t": F.try_divide(total, made)}
    for label, _, _ in COST_COMPONENTS:
        columns |= {f"cost_share_{label}_pct": F.try_divide(F.col(f"{label}_cost"), total) * 100, f"lcoa_component_{label}_per_t": F.try_divide(F.col(f"{label}_cost"), made)}
    columns |= {"other_cost_pct": F.try_divide(rest, total) * 100, "lcoa_component_other_per_t": F.try_divide(rest, made), "capital_cost_share_pct": F.try_divide(F.col("total_capital"), total) * 100}
    return breakdown.select("cell_id", "total_cost", *(v.alias(k) for k, v in columns.items()))


def weighted_interest_rate(rates: DataFrame, capacity: DataFrame, costs: DataFrame) -> DataFrame:
    """(cell_id, interest_rate_overall): weighted by capital cost, else by capacity, else the mean."""
    both = rates.where(F.col("interest_rate").isNotNull()).join(capacity, ["cell_id", "name"], "left").join(costs.select("name", "capital_cost"), "name", "left")
    size = F.greatest(F.coalesce("optimum", F.lit(0.0)), F.lit(0.0))
    weight = F.greatest(size * F.coalesce("capital_cost", F.lit(0.0)), F.lit(0.0))
    mean = lambda w: F.try_divide(F.sum(w * F.col("interest_rate")), F.sum(w))
    return both.groupBy("cell_id").agg(F.coalesce(mean(weight), mean(size), F.avg("interest_rate")).alias("interest_rate_overall"))


def capacity_columns(capacity: DataFrame, links: DataFrame, energy: DataFrame, store_scale: float = 1.0) -> DataFrame:
    """A row per cell: generators and stores as solved, links on their output, penalty and grid as energy, one figure for
    the battery's converters, hydrogen storage in tonnes too."""
    both = capacity.join(links.select("name", "efficiency"), "name", "left").withColumn("size", output_capacity(F.col("optimum"), F.col("efficiency")))
    of = lambda n, scale=1.0: (F.sum(F.when(F.col("name") == n, F.col("size"))) * scale).alias(n)
    plain = [of(n) for n in ("wind", "solar", "solar_tracking", "electrolysis", "hydrogen_compression", "ammonia_synthesis")]
    stores = [of(n, store_scale) for n in ("ammonia", "compressed_hydrogen_store", "battery_storage")]
    charge = F.greatest(*(F.coalesce(F.sum(F.when(F.col("name") == n, F.col("size"))), F.lit(0.0)) for n in ("battery_pcs_charge", "battery_pcs_discharge")))
    wide = both.groupBy("cell_id").agg(*plain, *stores, charge.alias("battery_pcs_mw"))
    wide = wide.withColumn("hydrogen_storage_capacity", F.col("compressed_hydrogen_store") / HYDROGEN_MWH_PER_T)
    return wide.join(energy.select("cell_id", F.col("penalty_link_mwh").alias("penalty_link"), "grid_mwh"), "cell_id", "left").withColumnRenamed("grid_mwh", "grid_energy_mwh")


def land_used(capacity: DataFrame, cells: DataFrame, solar_km2_per_mw: float, wind_km2_per_mw: float) -> DataFrame:
    """(cell_id, land_used_km2): solar by the cell's density, else by its land use; wind by its land use."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.greatest("optimum", F.lit(0.0)))), F.lit(0.0))
    wide = capacity.groupBy("cell_id").agg(of("solar", "solar_tracking").alias("solar"), of("wind").alias("wind"))
    both = wide.join(cells.select("cell_id", "solar_density_mw_per_km2"), "cell_id", "left")
    density = F.when(F.col("solar_density_mw_per_km2") > 0, F.col("solar_density_mw_per_km2"))
    return both.select("cell_id", (F.coalesce(F.col("solar") / density, F.col("solar") * solar_km2_per_mw) + F.col("wind") * wind_km2_per_mw).alias("land_used_km2"))


def land_cost_per_t(rows: DataFrame) -> DataFrame:
    """rows(land_cost_usd_per_km2_year, land_used_km2, annual_ammonia_production_t, ...) with land_cost_per_t."""
    made = F.col("annual_ammonia_production_t")
    return rows.withColumn("land_cost_per_t", F.when(made > 0, F.col("land_cost_usd_per_km2_year") * F.col("land_used_km2") / made))


def headline_splits(capacity: DataFrame, techs: DataFrame, overrides: DataFrame, objective: DataFrame, links: DataFrame | None = None, store_scale: float = 1.0) -> DataFrame:
    """(cell_id, build/tech/om/interest pct, build_cost_multiplier_applied) of the total cost, without double counting.

    A cell's multiplier counts where it has a rate too, as for its costs; the applied multiplier compares scaled costs
    on both sides.
    """
    both = capacity.withColumnRenamed("name", "tech").join(techs, "tech").join(overrides, ["cell_id", "tech"], "left")
    efficiency = F.when(F.col("component_type") == "link", F.coalesce("eff", F.lit(1.0))).otherwise(1.0)
    scale = F.when(F.col("component_type") == "store", store_scale).otherwise(1.0)
    years, rate = F.coalesce("lifetime", F.lit(DEFAULT_LIFETIME)), F.coalesce("interest_rate", "rate", F.lit(DEFAULT_RATE))
    multiplier = F.when(F.col("interest_rate").isNotNull(), F.coalesce("build_cost_multiplier", F.lit(1.0))).otherwise(1.0)
    size = F.col("optimum") * efficiency * scale
    both = both.where((F.col("optimum") > 0) & F.col("tech_cost").isNotNull() & F.col("build_cost").isNotNull() & (years > 0))
    both = both.select("cell_id", (F.col("tech_cost") * size).alias("tech_part"), (F.col("build_cost") * size).alias("base"), (F.col("build_cost") * size * multiplier).alias("build"), years.alias("years"), rate.alias("r"), F.coalesce("om", F.lit(DEFAULT_OM)).alias("o"))
    whole = F.col("tech_part") + F.col("build")
    interest = F.greatest(F.lit(0.0), whole * capital_recovery(F.col("r"), F.col("years")) - whole / F.col("years"))
    sums = both.groupBy("cell_id").agg(F.sum(F.col("build") / F.col("years")).alias("b"), F.sum(F.col("tech_part") / F.col("years")).alias("t"), F.sum(whole * F.col("o")).alias("m"), F.sum(interest).alias("i"), F.try_divide(F.sum("build"), F.sum("base")).alias("applied"))
    sums = sums.join(objective.where("objective > 0"), "cell_id")
    pct = lambda c: F.col(c) / F.col("objective") * 100
    return sums.select("cell_id", pct("b").alias("build_cost_pct"), pct("t").alias("tech_cost_pct"), pct("m").alias("om_cost_pct"), pct("i").alias("interest_pct"), F.coalesce("applied", F.lit(1.0)).alias("build_cost_multiplier_applied"))


def rescale_splits(rows: DataFrame) -> DataFrame:
    """rows with water and land shares of the cost that includes both, and the four splits scaled to leave room."""
    made, total = F.col("annual_ammonia_production_t"), F.col("total_cost")
    water, land = (F.coalesce(F.col(c), F.lit(0.0)) * made for c in ("water_cost_per_t", "land_cost_per_t"))
    everything = total + water + land
    usable = (made != 0) & (total != 0) & (everything > 0)
    share = lambda c: F.when(usable, F.col(c) * made / everything * 100)
    scaled = {c: F.when(usable, F.col(c) * total / everything).otherwise(F.col(c)) for c in ("build_cost_pct", "tech_cost_pct", "om_cost_pct", "interest_pct")}
    all_in = F.try_divide(everything, made)
    return rows.withColumns({"water_cost_pct": share("water_cost_per_t"), "land_cost_pct": share("land_cost_per_t"), "lcoa_all_in_per_t": all_in, **scaled})
