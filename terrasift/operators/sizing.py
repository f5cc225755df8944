"""Figures of given mixes of wind and solar on hourly profiles. A screening answer: no chemistry, no ramp limits, no losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def net_flow(wind_mw: Column, solar_mw: Column, demand: float) -> Column:
    """What a mix makes in an hour beyond the demand; a missing profile makes nothing."""
    return F.coalesce("wind", F.lit(0.0)) * wind_mw + F.coalesce("solar", F.lit(0.0)) * solar_mw - demand


def capacity_sweep(frame: DataFrame, mixes: list[tuple[int, float, float, float]], demand: float, storage_cost: float) -> DataFrame:
    """(cell_id, mix, storage, cost, unmet) of frame(cell_id, hour_index, wind, solar) for each of mixes, (mix, wind_mw,
    solar_mw, mix_cost).

    Storage that carries a cyclic year is the largest fall of the running sum over two years in a row; a mix that makes
    less than the demand is infeasible. Every hour is looked at once for each mix and year, in a window for each cell and
    mix; mixes are a short list of a parameter's size.
    """
    each = F.array(*(F.struct(F.lit(m).alias("mix"), F.lit(float(w)).alias("wind_mw"), F.lit(float(s)).alias("solar_mw"), F.lit(float(c)).alias("mix_cost")) for m, w, s, c in mixes))
    net = frame.select("*", F.inline(each)).select("cell_id", "mix", "mix_cost", "hour_index", net_flow(F.col("wind_mw"), F.col("solar_mw"), demand).alias("net"))
    twice = net.withColumn("year", F.explode(F.array(F.lit(0), F.lit(1))))
    order = Window.partitionBy("cell_id", "mix").orderBy("year", "hour_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fallen = twice.withColumn("sum", F.sum("net").over(order)).withColumn("fall", F.max("sum").over(order) - F.col("sum"))
    sized = fallen.groupBy("cell_id", "mix", "mix_cost").agg(F.sum(F.when(F.col("year") == 0, F.col("net"))).alias("surplus"), F.max("fall").alias("storage"), F.sum(F.when(F.col("year") == 0, F.greatest(F.lit(0.0), -F.col("net")))).alias("unmet"))
    feasible = F.col("surplus") >= 0
    return sized.select("cell_id", "mix", F.when(feasible, F.col("storage")).alias("storage"), F.when(feasible, F.col("mix_cost") + F.col("storage") * storage_cost).alias("cost"), "unmet")


def best_mix(sized: DataFrame) -> DataFrame:
    """The cheapest feasible mix of each cell, of equal ones the first."""
    feasible = sized.where("cost is not null")
    return feasible.groupBy("cell_id").agg(F.min(F.struct("cost", "mix", "storage")).alias("b")).select("cell_id", "b.mix", "b.storage", "b.cost")


def backstop_energy(frame: DataFrame, wind_mw: float, solar_mw: float, demand: float) -> DataFrame:
    """(cell_id, unmet_mwh): energy a mix without storage leaves to the backstop."""
    flow = net_flow(F.lit(wind_mw), F.lit(solar_mw), demand)
    return frame.groupBy("cell_id").agg(F.sum(F.greatest(F.lit(0.0), -flow)).alias("unmet_mwh"))
