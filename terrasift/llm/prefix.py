"""Running totals and row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, keys: list[str], spread: str, value: str, ties: list[str], to: str) -> DataFrame:
    """rows plus column ``to``: the sum of ``value`` over the group's rows before this one, ordered by spread, then ties.

    spread is a well-spread long. Its high bits cut each group in 2 ** 10 pieces of 2 ** 10 pieces, whose sums are
    added up level by level, so a window sees at most 1,024 rows of sums, or one part in 2 ** 20 of a group.
    keys must not be null. Rows equal in spread and ties get their totals in any order among themselves.
    """
    high, low = F.shiftrightunsigned(F.col(spread), 54), F.shiftrightunsigned(F.col(spread), 44).bitwiseAND(1023)
    rows = rows.withColumns({"__high": high, "__low": low})
    before = lambda over: over.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, over: F.coalesce(F.sum(c).over(before(over)), F.lit(0))
    fine = rows.groupBy(*keys, "__high", "__low").agg(F.sum(value).alias("__sum"))
    coarse = fine.groupBy(*keys, "__high").agg(F.sum("__sum").alias("__sum"))
    coarse = coarse.select(*keys, "__high", total("__sum", Window.partitionBy(*keys).orderBy("__high")).alias("__base"))
    fine = fine.select(*keys, "__high", "__low", total("__sum", Window.partitionBy(*keys, "__high").orderBy("__low")).alias("__offset"))
    fine = fine.join(coarse, [*keys, "__high"]).withColumn("__offset", F.col("__offset") + F.col("__base")).drop("__base")
    own = Window.partitionBy(*keys, "__high", "__low").orderBy(spread, *ties)
    rows = rows.withColumn(to, total(value, own)).join(fine, [*keys, "__high", "__low"])
    return rows.withColumn(to, F.col(to) + F.col("__offset")).drop("__high", "__low", "__offset")


def word_count(text: Column) -> Column:
    """Runs of anything but space and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
