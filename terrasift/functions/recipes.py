"""Recipes: maps of carriers to amounts, in and out, of a component."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_map(m: Column) -> Column:
    """A map of doubles without nulls; an empty one is null."""
    kept = F.map_filter(F.transform_values(m, lambda _, v: v.cast("double")), lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)


def overall_efficiency(ins: Column, outs: Column) -> Column:
    return F.when(total(ins) > 0, total(outs) / total(ins))


def first_efficiency(ins: Column, outs: Column, bus0: Column, bus1: Column) -> Column:
    """Output on bus1 for each unit taken from bus0."""
    return F.try_divide(F.try_element_at(outs, bus1), F.try_element_at(ins, bus0))


def second_efficiency(ins: Column, outs: Column, bus0: Column, bus2: Column) -> Column:
    """Flow on bus2 for each unit taken from bus0: below 0 where bus2 is an input."""
    base = F.try_element_at(ins, bus0)
    return F.coalesce(F.try_divide(-F.try_element_at(ins, bus2), base), F.try_divide(F.try_element_at(outs, bus2), base))


def recipe_per_output(bus0: Column, bus1: Column, bus2: Column, efficiency: Column, efficiency2: Column) -> tuple[Column, Column]:
    """(in, out) for one unit on bus1."""
    flow = F.coalesce(efficiency2, F.lit(0.0)) / efficiency
    none = F.create_map().cast("map<string,double>")
    ins = F.map_concat(F.create_map(bus0, 1 / efficiency), F.when(bus2.isNotNull() & (flow < 0), F.create_map(bus2, -flow)).otherwise(none))
    outs = F.map_concat(F.create_map(bus1, F.lit(1.0)), F.when(bus2.isNotNull() & (flow >= 0), F.create_map(bus2, flow)).otherwise(none))
    return ins, outs


def extra_keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b)))


def differing_keys(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    """Carriers in both whose amounts differ by more than the tolerance, relative to the first with a floor of 1."""
    differs = lambda k: F.abs(F.element_at(a, k) - F.element_at(b, k)) > tolerance * F.greatest(F.lit(1.0), F.abs(F.element_at(a, k)))
    return F.array_sort(F.filter(F.array_intersect(F.map_keys(a), F.map_keys(b)), differs))
