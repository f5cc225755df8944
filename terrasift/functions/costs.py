"""Annuities, bases of cost, depth multipliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import AMMONIA_HYDROGEN_SHARE, DEPTH_CURVES, HYDROGEN_MWH_PER_T


def capital_recovery(rate: Column, years: Column) -> Column:
    """r (1 + r) ** n / ((1 + r) ** n - 1); 1 / n for a rate of about 0. A lifetime that isn't positive is an error."""
    growth = F.pow(1 + rate, years)
    value = F.when(F.abs(rate) < 1e-12, 1 / years).otherwise(rate * growth / (growth - 1))
    return F.when(years > 0, value).when(years <= 0, F.raise_error(F.lit("lifetime must be positive")).cast("double"))


def annual_cost(overnight: Column, rate: Column, years: Column, fixed_om: Column) -> Column:
    return overnight * (capital_recovery(rate, years) + fixed_om)


def to_input_basis(cost: Column, efficiency: Column) -> Column:
    """A cost per output as a cost per input. An efficiency that isn't positive is an error."""
    return F.when(efficiency > 0, cost * efficiency).otherwise(F.raise_error(F.lit("efficiency must be positive")).cast("double"))


def store_scale(time_step: float = 1.0, aggregation: int = 1) -> float:
    return float(time_step) * float(aggregation)


def output_capacity(capacity: Column, efficiency: Column) -> Column:
    """A link's capacity on its output; a missing efficiency is 1."""
    return capacity * F.coalesce(efficiency, F.lit(1.0))


def depth_multiplier(depth: Column, tech: Column) -> Column:
    """Cost multiplier at a sea depth: linear between the curve's points, flat beyond, 1 on land or without depth; to four
    decimals, halves to even. Wind has a curve of its own."""

    def along(points: tuple[tuple[float, float], ...]) -> Column:
        pieces = [(d1, F.lit(m0) + (depth - d0) / (d1 - d0) * (m1 - m0)) for (d0, m0), (d1, m1) in zip(points[:-1], points[1:], strict=True)]
        last = F.lit(float(points[-1][1]))
        return reduce(lambda rest, p: F.when(depth <= p[0], p[1]).otherwise(rest), reversed(pieces), last)

    value = F.when(tech == "wind", along(DEPTH_CURVES["wind"])).otherwise(along(DEPTH_CURVES["plant"]))
    return F.bround(F.when(depth > 0, value).otherwise(1.0), 4)


def effective_depth(onshore_pct: Column, depth: Column) -> Column:
    """The depth of cells that are all sea, else 0."""
    return F.when(onshore_pct == 0, F.abs(depth)).otherwise(0.0)


def hydrogen_t_per_h(mw: Column) -> Column:
    return mw / HYDROGEN_MWH_PER_T


def ammonia_t_per_h(hydrogen_t: Column) -> Column:
    return hydrogen_t / AMMONIA_HYDROGEN_SHARE


def legacy_annual_cost(cost: Column, om_percent: Column, recovery_percent: Column) -> Column:
    """The old conversion, kept as written: it divides by a recovery factor that comes from percent inputs."""
    return cost * om_percent / 100 + cost / recovery_percent
