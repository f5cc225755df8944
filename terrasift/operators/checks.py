"""Rules that a solved design has to keep; each check returns the rows that break one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .weather import cyclic_change


def ramp_violations(dispatch: DataFrame, capacity: DataFrame, limit: float) -> DataFrame:
    """Snapshots whose change from the one before (the first: from the last) is above limit times the capacity."""
    change = cyclic_change(dispatch.select("cell_id", "name", "ts", "p")).join(capacity, ["cell_id", "name"])
    return change.withColumn("change", F.abs(F.col("p") - F.col("previous"))).where(F.col("change") > F.col("optimum") * limit).select("cell_id", "name", "ts", "change", "optimum")


def cap_violations(capacity: DataFrame, shared: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(cell_id, rule, size, cap): wind above its cap; both kinds of solar above the cap that they share."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.col("optimum"))), F.lit(0.0))
    both = capacity.groupBy("cell_id").agg(of("wind").alias("wind"), of("solar", "solar_tracking").alias("solar")).join(shared, "cell_id")
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("size"), F.col(c).alias("cap")) for n, c in (("wind", "wind_cap_mw"), ("solar", "shared_solar_cap_mw"))))
    return both.select("cell_id", F.inline(rules)).where(F.col("size") > F.col("cap") + tolerance)


def battery_violations(capacity: DataFrame, efficiency: float, cycles: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Cells whose charger isn't the discharger over the efficiency, or, with cycles, whose hydrogen store is larger than
    the yearly cycles allow for its compressor."""
    of = lambda n: F.coalesce(F.sum(F.when(F.col("name") == n, F.col("optimum"))), F.lit(0.0)).alias(n)
    wide = capacity.groupBy("cell_id").agg(of("battery_pcs_charge"), of("battery_pcs_discharge"), of("hydrogen_compression"), of("compressed_hydrogen_store"))
    gap = F.abs(F.col("battery_pcs_charge") - F.col("battery_pcs_discharge") / efficiency) > tolerance
    over = F.lit(False) if cycles is None else F.col("compressed_hydrogen_store") * cycles > F.col("hydrogen_compression") + tolerance
    return wide.withColumns({"converter_gap": gap, "too_large": over}).where("converter_gap or too_large")


def bus_balance(dispatch: DataFrame, ports: DataFrame, load: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(cell_id, ts, bus, net, load): buses where the flows through ports(name, bus, coef) don't add up to the load.

    ports and load are a plant's, whose few names would be as many tasks in a shuffle of the dispatch, so they are broadcast.
    """
    net = dispatch.join(F.broadcast(ports), "name").groupBy("cell_id", "ts", "bus").agg(F.sum(F.col("p") * F.col("coef")).alias("net"))
    both = net.join(F.broadcast(load), "bus", "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
    return both.where(F.abs(F.col("net") - F.col("load")) > tolerance).select("cell_id", "ts", "bus", "net", "load")


def availability_violations(dispatch: DataFrame, weather: DataFrame, capacity: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Generation above capacity times the hour's factor; the grid's factor is 1."""
    both = dispatch.join(capacity, ["cell_id", "name"]).join(weather.withColumnRenamed("resource", "name"), ["cell_id", "name", "ts"], "left")
    factor = F.when(F.col("name") == "grid", 1.0).otherwise(F.col("cf"))
    return both.withColumn("most", F.col("optimum") * factor).where(F.col("p") > F.col("most") + tolerance).select("cell_id", "name", "ts", "p", "most")


def low_load_violations(dispatch: DataFrame, capacity: DataFrame, share: float = 0.3, name: str = "ammonia_synthesis") -> DataFrame:
    both = dispatch.where(F.col("name") == name).join(capacity, ["cell_id", "name"])
    return both.withColumn("least", F.col("optimum") * share).where(F.col("p") < F.col("least")).select("cell_id", "name", "ts", "p", "least")


def missing_carriers(components: list[DataFrame], carriers: DataFrame) -> DataFrame:
    """Carriers that a component names and the carrier table lacks."""
    used = components[0].select("carrier")
    for more in components[1:]:
        used = used.unionByName(more.select("carrier"))
    return used.dropna().distinct().join(carriers.select(F.col("name").alias("carrier")), "carrier", "left_anti")
