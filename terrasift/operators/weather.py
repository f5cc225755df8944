"""Hourly series: dense calendars, resampling, filling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import WAKE_FACTOR
from ..sources.folders import stored
from .lookup import nearest_grid


#: Rows of a dense table that a task makes, about; it holds, sorts and groups these in memory.
TASK_ROWS = 1 << 21


def dense_hours(series: DataFrame, value: str = "cf", by: tuple[str, ...] = ("cell_id",), span_of: DataFrame | None = None) -> DataFrame:
    """series(cell_id, resource, ts, value) with a row for each hour of the table's span, numbered from 0; gaps are 0.

    Given rows alone are moved: they are dealt by the columns of by, and a row makes the hours up to its series' next one
    where it is, so that what groups the hours by these columns, or these and others, moves nothing more. As many tasks
    are made as hours there will be need, known from one aggregate. by: columns that tell apart series, or sets of them,
    which stay as columns. span_of: the table whose span counts, if series is a part of it.
    """
    of_span = (F.min("ts").alias("first"), F.max("ts").alias("last"))
    found = series.agg(*of_span, F.approx_count_distinct(F.xxhash64("cell_id", "resource")).alias("n"))
    row = (found if span_of is None else span_of.agg(*of_span).crossJoin(found.select("n"))).select(F.unix_micros("first"), F.unix_micros("last"), "n").first()
    first, hours = row[0], 0 if row[0] is None else (row[1] - row[0]) // 3_600_000_000 + 1
    tasks = max(series.sparkSession.sparkContext.defaultParallelism, -(-row[2] * hours // TASK_ROWS))
    since = F.unix_micros("ts") - F.lit(first).cast("long")
    known = F.col("cell_id").isNotNull() & F.col("resource").isNotNull() & (since % 3_600_000_000 == 0) & since.between(0, (hours - 1) * 3_600_000_000)
    keys = list(dict.fromkeys((*by, "cell_id", "resource")))
    # hours that aren't in the calendar, and those of series without a name, count as -1: they make gaps alone
    rows = series.select(*keys, F.coalesce(F.col(value), F.lit(0.0)).alias(value), F.when(known, since / 3_600_000_000).otherwise(-1).cast("int").alias("at"))
    order = Window.partitionBy(*keys).orderBy("at")
    start, end = F.when(F.lag("at").over(order).isNull(), 0).otherwise(F.col("at")), F.coalesce(F.lead("at").over(order), F.lit(hours)) - 1
    ends = rows.repartition(tasks, *by).select("*", start.alias("start"), F.greatest(end, "at").alias("end"))
    made = ends.where("end >= start and end >= 0").select(*keys, value, "at", F.explode(F.sequence(F.greatest("start", F.lit(0)), "end")).alias("hour_index"))
    ts = F.timestamp_micros(F.lit(first).cast("long") + F.col("hour_index").cast("long") * 3_600_000_000).cast(series.schema["ts"].dataType).alias("ts")
    return made.select(*keys, ts, "hour_index", F.when(F.col("hour_index") == F.col("at"), F.col(value)).otherwise(0.0).alias(value))


def weather_frame(dense: DataFrame, wake: float = WAKE_FACTOR, key: str = "cell_id") -> DataFrame:
    """(cell_id, hour_index, solar, wind, solar_tracking, grid, ramp_dummy): wind loses its wakes; a missing tracking
    profile is that of solar."""
    of = lambda n: F.max(F.when(F.col("resource") == n, F.col("cf")))
    wide = dense.groupBy(key, "hour_index").agg(of("solar").alias("solar"), (of("wind") * wake).alias("wind"), of("solar_tracking").alias("solar_tracking"))
    return wide.withColumns({"solar_tracking": F.coalesce("solar_tracking", "solar"), "grid": F.lit(0.0), "ramp_dummy": F.lit(1.0)})


def site_weather(locations: DataFrame, weather: DataFrame) -> DataFrame:
    """Hours of the nearest grid point for each location(latitude, longitude)."""
    grid = weather.select("latitude", "longitude").distinct()
    near = nearest_grid(locations, grid, tie="greatest")
    return near.join(weather.withColumnsRenamed({"latitude": "near_lat", "longitude": "near_lon"}), ["near_lat", "near_lon"])


def location_frame(locations: DataFrame, series: DataFrame, places: DataFrame, wake: float = WAKE_FACTOR) -> DataFrame:
    """weather_frame of the nearest grid point of each location(cell_id, latitude, longitude), cell_id being its key, from
    series(cell_id, resource, ts, cf) of cells at places(cell_id, latitude, longitude). A point has the highest values of
    its cells; its frame is made once, and hours are moved once for a point, whatever the number of locations at it.
    """
    place = ["latitude", "longitude"]
    there = places.join(series.select("cell_id"), "cell_id", "left_semi")
    points = stored(there.select(*place).distinct().withColumn("point", F.monotonically_increasing_id()), "points")
    own = there.join(points, place).select("cell_id", "point")
    frame = weather_frame(dense_hours(series.join(own, "cell_id"), by=("point",), span_of=series), wake, "point")
    near = nearest_grid(locations.select("cell_id", *place), points, tie="greatest").where("point is not null").select("cell_id", "point").distinct()
    return near.join(frame, "point").drop("point")


def missing_profiles(generators: DataFrame, profiles: DataFrame) -> DataFrame:
    """Generators without a profile; tracking may use solar's; grid and ramp_dummy need none."""
    known = profiles.select("resource").distinct()
    known = known.unionByName(known.where("resource = 'solar'").select(F.lit("solar_tracking").alias("resource"))).distinct()
    return generators.where(~F.col("name").isin("grid", "ramp_dummy")).join(known, F.col("name") == F.col("resource"), "left_anti")


def first_hours(dense: DataFrame, m: int) -> DataFrame:
    return dense.where(F.col("hour_index") < m)


def _blocks(dense: DataFrame, k: int, value: str) -> DataFrame:
    """(cell_id, resource, block, mean, sum, hours) of k hours each; the last block may have fewer."""
    return dense.groupBy("cell_id", "resource", F.floor(F.col("hour_index") / k).cast("int").alias("block")).agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.count("*").alias("hours"))


def _all_whole(blocks: DataFrame, k: int) -> DataFrame:
    """blocks, none of which may lack hours, as then the number of all hours is no multiple of k."""
    whole = F.when(F.col("hours") == k, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{k} does not divide the hours, a block has "), F.col("hours").cast("string"))).cast("boolean"))
    return blocks.where(whole)


def block_mean(dense: DataFrame, k: int, value: str = "cf") -> DataFrame:
    """Means of k hours each of a table in which every series has every hour; hours beyond the last whole block go."""
    return _blocks(dense, k, value).where(F.col("hours") == k).select("cell_id", "resource", "block", F.col("mean").alias(value))


def block_mean_strict(dense: DataFrame, k: int, value: str = "cf") -> DataFrame:
    """As block_mean, but the hours have to be a multiple of k, and a series with a mean of 0 or less is 0."""
    level = F.avg("mean").over(Window.partitionBy("cell_id", "resource"))
    return _all_whole(_blocks(dense, k, value), k).select("cell_id", "resource", "block", F.when(level <= 0, 0.0).otherwise(F.col("mean")).alias(value))


def block_sum(dense: DataFrame, k: int, value: str = "cf") -> DataFrame:
    """Sums of k hours each, with their number as weight; the hours have to be a multiple of k."""
    return _all_whole(_blocks(dense, k, value), k).select("cell_id", "resource", "block", F.col("sum").alias(value), F.col("hours").alias("weights"))


def cyclic_change(series: DataFrame, value: str = "p") -> DataFrame:
    """series with previous, the value of the snapshot before; the first sees the last."""
    order = Window.partitionBy("cell_id", "name").orderBy("ts")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.withColumn("previous", F.coalesce(F.lag(value).over(order), F.last(value).over(everything)))


def filled_weights(snapshots: DataFrame) -> DataFrame:
    """snapshots(cell_id, ts, weight): gaps take the weight before, else the one after, else 1."""
    order = Window.partitionBy("cell_id").orderBy("ts")
    before = F.last("weight", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("weight", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return snapshots.withColumn("weight", F.coalesce(before, after, F.lit(1.0)))


def neighbour_distance(hours: DataFrame, columns: list[str]) -> DataFrame:
    """Distance of each hour to the next one: twice the sum of differences, times w w' / (w + w')."""
    order = Window.partitionBy("cell_id").orderBy("hour_index")
    gap = sum((F.abs(F.lead(c).over(order) - F.col(c)) for c in columns), F.lit(0.0))
    following = F.lead("weights").over(order)
    return hours.withColumn("distance", 2 * gap * F.col("weights") * following / (F.col("weights") + following))


def merge_neighbours(values: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the closest neighbours, of equal ones the first, until n rows are left; both distances of a merged row are
    renewed. A heap of distances over a linked list: entries of rows that have changed since are passed over. Rows are
    lists, as each merge is of a few numbers. Equal neighbours come first; where all of them are merged, or none but zeros
    are equal, zeros, whose means are exact, are merged in one pass."""
    rows, weight = values.astype(float).tolist(), weights.astype(float).tolist()
    merges = len(rows) - max(n, 1)
    empty = [not any(row) for row in rows]
    again = [False, *(a and b for a, b in zip(empty, empty[1:], strict=False))]
    equal, zeros = sum(a == b for a, b in zip(rows, rows[1:], strict=False)), sum(again)
    if equal <= merges or equal == zeros:
        kept, sums = [], []
        for row, w, more in zip(rows, weight, again, strict=True):
            if more and merges > 0:
                sums[-1] += w
                merges -= 1
            else:
                kept.append(row)
                sums.append(w)
        rows, weight = kept, sums
    count = len(rows)
    following, before, changes = list(range(1, count + 1)), list(range(-1, count - 1)), [0] * count

    def entry(i: int) -> tuple[float, int, int, int]:
        j = following[i]
        a, b, gap = weight[i], weight[j], 0.0
        for x, y in zip(rows[i], rows[j], strict=True):
            gap += abs(y - x)
        return 2 * gap * a * b / (a + b), i, changes[i], changes[j]

    gaps = [entry(i) for i in range(count - 1)]
    heapq.heapify(gaps)
    for _ in range(merges):
        while True:
            _, i, own, other = heapq.heappop(gaps)
            if changes[i] == own and changes[following[i]] == other:
                break
        j = following[i]
        a, b = weight[i], weight[j]
        rows[i] = [(x * a + y * b) / (a + b) for x, y in zip(rows[i], rows[j], strict=True)]
        weight[i] = a + b
        after = following[i] = following[j]
        changes[i] += 1
        changes[j], rows[j] = -1, None
        if after < count:
            before[after] = i
            heapq.heappush(gaps, entry(i))
        if before[i] >= 0:
            heapq.heappush(gaps, entry(before[i]))
    left = [i for i in range(count) if changes[i] >= 0]
    return values.astype(float)[:0] if not left else np.array([rows[i] for i in left]), np.array([weight[i] for i in left])


def cluster_hours(hours: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Adjacent hours of each cell clustered to a k-th of their number; sequential in a cell, parallel over cells.

    A window numbers the hours of a cell, which leaves them together and in order; cells are cut from batches of them, so
    that a batch is handed over once and not once a cell.
    """
    schema = "cell_id long, cluster int, weights double, " + ", ".join(f"{c} double" for c in columns)

    def clustered(cells: list[tuple[int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if cells:
            ids, values = zip(*cells, strict=True)
            values, weights = zip(*(merge_neighbours(v, np.ones(len(v)), len(v) // k) for v in values), strict=True)
            cell, cluster = [i for i, w in zip(ids, weights, strict=True) for _ in w], [np.arange(len(w), dtype=np.int32) for w in weights]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *map(pa.array, (np.concatenate(cluster), np.concatenate(weights), *np.concatenate(values).T))], ["cell_id", "cluster", "weights", *columns])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, seen = None, [], 0
        for batch in batches:
            place, ids = batch.column("place").to_numpy(), batch.column("cell_id")
            if np.any((place != 1) & (place != np.concatenate([[seen], place[:-1]]) + 1)):
                raise ValueError("hours aren't in order")
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            starts, done = np.flatnonzero(place == 1).tolist(), []
            if head := starts[0] if starts else len(place):
                parts.append(values[:head])
            for begin, end in zip(starts, [*starts[1:], len(place)], strict=False):
                if parts:
                    done.append((last, np.concatenate(parts)))
                last, parts = ids[begin].as_py(), [values[begin:end]]
            seen = place[-1] if len(place) else seen
            yield from clustered(done)
        yield from clustered([(last, np.concatenate(parts))] if parts else [])

    place = F.row_number().over(Window.partitionBy("cell_id").orderBy("hour_index"))
    return hours.select("cell_id", place.alias("place"), *columns).mapInArrow(merge, schema)
