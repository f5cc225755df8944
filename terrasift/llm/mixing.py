"""Mixing sources to time-varying target weights.

A source's schedule gives its weight at points of training time 0 to 1, linear between them. The integral of the
schedule sets the source's share of the mix; the running integral is its cumulative demand. What is taken of a source
stands in hashed order, pass by pass; the time at which the demand reaches a document's place in it, found by inverting
the demand, is its training position. Sorting by position gives the curriculum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpoint, spare_name
from .prefix import running_total, word_count

SEED, MOST_COPIES = 20250101, 3
#: Times that what a source still misses is filled, in the hashed order, from documents that fit into it.
FILLS = 2
#: Part of a target that whole documents may miss it by.
NEAR = 0.005
#: Up to this many sources, their figures are broadcast to the documents; beyond it they are joined by a shuffle.
FEW_SOURCES = 10_000


def source_targets(totals: DataFrame, schedule: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(name, is_null, source_size, target, segments) for totals(name, is_null, source_size).

    schedule(name, is_null, t, weight) has at least the points t = 0 and t = 1 of every source. Targets share the sum
    of all sizes by integrated weight; none is above most times its source's size, and what it would have above goes to
    the others by weight, until none is above. One row per source is all this works on.
    """
    key = ["name", "is_null"]
    step = Window.partitionBy(*key).orderBy("t")
    parts = schedule.select(*key, F.col("t").alias("t0"), F.lead("t").over(step).alias("t1"), F.col("weight").alias("w0"), F.lead("weight").over(step).alias("w1")).where("t1 > t0")
    parts = parts.withColumn("area", (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2)
    parts = parts.withColumn("done", F.coalesce(F.sum("area").over(Window.partitionBy(*key).orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    weights = parts.groupBy(*key).agg(F.sum("area").alias("weight"), F.sort_array(F.collect_list(F.struct("t0", "t1", "w0", "w1", "area", "done"))).alias("segments"))
    both = totals.join(weights, key)
    both = both.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.coalesce(F.try_divide("cap", "weight"), F.lit(float("inf"))))
    order = Window.orderBy("ratio", *key)
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    both = both.withColumn("level", F.try_divide(left, share))
    both = both.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return both.select(*key, "source_size", target.alias("target"), "segments")


def _position(u: Column) -> Column:
    """The time at which the demand of the row's schedule, in segments, reaches the fraction u of the whole."""
    whole = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["area"])
    goal = u * whole
    part = F.try_element_at(F.filter("segments", lambda x: (x["area"] > 0) & (x["done"] <= goal)), F.lit(-1))
    rest = F.least(goal - part["done"], part["area"])
    slope = (part["w1"] - part["w0"]) / (part["t1"] - part["t0"])
    root = F.sqrt(F.greatest(part["w0"] * part["w0"] + slope * rest * 2, F.lit(0.0)))
    return part["t0"] + F.when(rest <= 0, F.lit(0.0)).otherwise(F.try_divide(rest * 2, part["w0"] + root))


def cycle_schedule(names: DataFrame) -> DataFrame:
    """(name, is_null, t, weight): weights 1, 2, 3, repeating by code point, null last; every other source starts at one
    and a half times its weight and ends at half of it, the others the other way round."""
    place = F.row_number().over(Window.orderBy("is_null", "name")) - 1
    ranked = names.select("name", "is_null", place.alias("place"))
    weight, early = (F.col("place") % 3 + 1).cast("double"), F.col("place") % 2 == 0
    begin, end = F.when(early, weight * 1.5).otherwise(weight * 0.5), F.when(early, weight * 0.5).otherwise(weight * 1.5)
    points = F.array(F.struct(F.lit(0.0).alias("t"), begin.alias("weight")), F.struct(F.lit(1.0).alias("t"), end.alias("weight")))
    return ranked.select("name", "is_null", F.inline(points))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedule=cycle_schedule, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """(id_col, source_col, size, source_size, target, copies, part, taken, positions), sorted by first position.

    schedule makes a source_targets schedule from (name, is_null). Sizes are words; a null text has none. A source with
    a target of k times its size and a rest takes every document k times, and once more those that lie before the rest
    in the order of hashed ids; what is missing is filled twice from the next documents that fit into it, then by the
    one document that brings the sum closest to the target. Only if that is still further than NEAR of the target away, as
    in a source of few long documents, does one document come in part, with ``part`` more words. Documents that aren't
    taken have no positions and come last. Rows of one id and size are taken in any order among themselves.
    A null source is a source; an empty table gives no rows.
    """
    key = ["name", "is_null"]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("name"), F.col(source_col).isNull().alias("is_null"), word_count(F.col(text_col)).alias("size"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = checkpoint(rows.withColumn("spread", F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 4)))
    totals = checkpoint(rows.groupBy(*key).agg(F.sum("size").alias("source_size")))
    by_source = F.broadcast if totals.count() <= FEW_SOURCES else (lambda side: side)
    targets = checkpoint(source_targets(totals, schedule(totals.select(*key)), most))
    rows = running_total(rows, key, "spread", "size", ["id", "size"], "before")

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows = rows.join(by_source(targets), key).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = checkpoint(rows.withColumn("more", (F.col("before") + F.col("size") <= F.col("rest")) & (F.col("size") > 0)))
    for _ in range(FILLS):
        left = rows.groupBy(*key).agg((F.first("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("missing"))
        small = rows.where("not more and size > 0").join(by_source(left), key).where("size <= missing").select(*key, "spread", "id", "size", "before", "missing")
        small = running_total(small, key, "spread", "size", ["before"], "sum").where("sum + size <= missing")
        small = small.select(*key, "spread", "before", "size", F.lit(True).alias("fills"))
        rows = rows.join(small, [*key, "spread", "before", "size"], "left").withColumn("more", F.col("more") | F.coalesce("fills", F.lit(False))).drop("fills")
        rows = checkpoint(rows)
    missing = rows.groupBy(*key).agg((F.first("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("missing"))
    gap = F.abs(F.col("size") - F.col("missing"))
    fit = rows.where("not more and size > 0").join(by_source(missing), key).groupBy(*key, "missing")
    fit = fit.agg(F.min(F.when(gap < F.col("missing"), F.struct(gap.alias("gap"), "size", "before"))).alias("fit"), F.min(F.when(F.col("size") > F.col("missing"), F.struct("size", "before"))).alias("cut"))
    rows = rows.join(by_source(fit), key, "left")
    is_ = lambda one: F.coalesce((F.col("size") == F.col(f"{one}.size")) & (F.col("before") == F.col(f"{one}.before")), F.lit(False)) & ~F.col("more")
    far = F.coalesce(F.coalesce("fit.gap", "missing") > F.col("target") * NEAR, F.lit(False)) & F.col("cut").isNotNull()
    rows = rows.withColumn("last", F.col("more") | (is_("fit") & ~far)).withColumn("part", F.when(is_("cut") & far, F.floor("missing")).otherwise(0).cast("long"))
    rows = rows.withColumn("copies", F.col("whole") + F.col("last").cast("int")).withColumn("extra", F.when(F.col("last"), F.col("size")).otherwise(F.col("part")))
    rows = checkpoint(rows.select(*key, "id", "spread", "size", "before", "source_size", "target", "segments", "whole", "copies", "part", "extra"))
    sums = rows.groupBy(*key).agg(F.sum("extra").alias("extras"))
    rows = running_total(rows, key, "spread", "extra", ["id", "size"], "extra_before").join(by_source(sums), key)
    # Demand is used up by what is taken: whole passes over the source first, then a pass over the documents that come once more.
    all_, passed = F.col("whole") * F.col("source_size") + F.col("extras"), F.col("whole") * F.col("source_size")
    whole_passes = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0), F.greatest("whole", F.lit(1)) - 1), lambda j: F.try_divide(j * F.col("source_size") + F.col("before") + F.col("size") / 2, all_)))
    last_pass = F.when(F.col("extra") > 0, F.array(F.try_divide(passed + F.col("extra_before") + F.col("extra") / 2, all_)))
    none = F.array().cast("array<double>")
    rows = rows.withColumn("u", F.when(F.col("size") > 0, F.concat(F.coalesce(whole_passes, none), F.coalesce(last_pass, none))).otherwise(none))
    rows = rows.withColumn("positions", F.transform("u", _position))
    out = rows.select(F.col("id").alias(id_col), F.when(~F.col("is_null"), F.col("name")).alias(source_col), "size", "source_size", "target", "copies", "part", (F.col("size") * F.col("copies") + F.col("part")).alias("taken"), "positions")
    return out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, with all their columns, range-sorted by position.

    Texts stay whole: one that is taken in part counts once more from half its size on. Texts without words come in every
    whole pass over their source, first. Rows of one id are told apart by
    size only; columns of any other name stay as they are. An empty table stays one.
    """
    chosen = mix(docs, id_col, text_col, source_col, **rule)
    rounded = F.col("copies") + (F.col("part") * 2 >= F.greatest("size", F.lit(1))).cast("int")
    chosen = checkpoint(chosen.select(F.col(id_col).alias("id"), "size", F.when(F.col("size") > 0, F.slice("positions", F.lit(1), rounded)).otherwise(F.array_repeat(F.lit(0.0), F.col("copies"))).alias("copies")))
    turn, copies, of = (spare_name(docs, n) for n in ("turn", "copies", "of"))
    by_id = lambda *order: F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    if chosen.groupBy("id").count().where("count > 1").isEmpty():
        chosen, rows = chosen.withColumn(turn, F.lit(1)), docs.withColumn(turn, F.lit(1))
    else:
        chosen = chosen.withColumn(turn, F.row_number().over(Window.partitionBy("id").orderBy("size", "copies")))
        rows = docs.withColumn(turn, by_id(word_count(F.col(text_col)), text_col, source_col))
    chosen = chosen.where(F.size("copies") > 0).select(F.col("id").alias(of), turn, F.explode("copies").alias(copies)).hint("shuffle_hash")
    same = rows[id_col].eqNullSafe(chosen[of]) & (rows[turn] == chosen[turn])
    found = rows.join(chosen, same).select(*(rows[c] for c in docs.columns), copies)
    return found.repartitionByRange(copies, id_col).sortWithinPartitions(copies, id_col).drop(copies)
