"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.results import order_columns
from ..schemas import BAND_DEGREES, CELLS, SHEET_KEYS, require_columns


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_cells(cells: DataFrame, path: str, kind: str = "parquet") -> None:
    """The 21 columns, range-sorted by place."""
    cells = require_columns(cells, *CELLS.names).select(*CELLS.names)
    write_table(cells.repartitionByRange("latitude", "longitude").sortWithinPartitions("latitude", "longitude"), path, kind)


def write_bands(places: DataFrame, path: str) -> None:
    """places in a folder for each band of longitude, range-sorted in it, so that a segment reads its own bands; see read_bands."""
    band = F.floor((F.col("longitude") + 180) / BAND_DEGREES).cast("int")
    dealt = places.withColumn("band", band).repartitionByRange("band", "longitude", "latitude").sortWithinPartitions("band", "longitude", "latitude")
    dealt.write.mode("overwrite").partitionBy("band").parquet(path)


def write_observed(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> dict[str, int]:
    """Writes df and returns rows and checksum of what was written, observed in passing."""
    seen = Observation()
    columns = df.columns
    write_table(df.observe(seen, *_figures(columns)), path, kind, mode)
    return seen.get


def _figures(columns: list[str]) -> list[Column]:
    """Rows, and the sum of their hashes, which no order or partitioning of them changes."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38, 0)")), F.lit(0).cast("decimal(38, 0)")).alias("checksum")]


def write_compiled(compiled: DataFrame, path: str) -> DataFrame:
    """Writes compiled costs, reads them again, and returns the techs whose cost came back different.

    Rows and checksum of the file, by one scan, are compared with those observed while writing; only a file that differs
    is joined with what was to be written.
    """
    compiled = compiled.select("tech", "capital_cost")
    written = write_observed(compiled, path)
    again = compiled.sparkSession.read.schema(compiled.schema).parquet(path)
    same = again.agg(*_figures(compiled.columns)).first().asDict() == written
    again = again.withColumnRenamed("capital_cost", "read")
    if same:
        return again.select("tech", F.col("read").alias("capital_cost"), "read").limit(0)
    return compiled.join(again, "tech", "full").where(~F.col("capital_cost").eqNullSafe(F.col("read"))).select("tech", "capital_cost", "read")


def append_results(results: DataFrame, path: str) -> None:
    """Adds finished cells of a segment; a job that is run again appends again, and combine_segments keeps the last. Where a
    segment is run as a whole, commit_segments replaces it."""
    require_columns(results, "segment").write.mode("append").partitionBy("segment").parquet(path)


def commit_segments(results: DataFrame, path: str) -> None:
    """Puts finished cells in place of what the table had of the same segments; segments that results has no row of stay.

    A segment is a folder, and all folders of a job are moved into place when all its tasks are done: a job that failed
    leaves the table as it was, and one that is run again replaces its own rows.
    """
    dealt = require_columns(results, "segment", "latitude", "longitude").repartitionByRange("segment", "latitude", "longitude")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(path)


def rewrite_in_order(results: DataFrame, requested: DataFrame, path: str, order: str = "file_order", kind: str = "parquet", once: bool = True) -> None:
    """results(latitude, longitude, ...) once for each place of requested(latitude, longitude, order), in that order.

    Parts of the order's range are files, named in order, and sorted; columns stand in report order. Places without a
    result aren't there, and results that weren't requested go. A place that is requested twice stands where it was first;
    without once, it stands at each of its requests.
    """
    asked = requested.select("latitude", "longitude", F.col(order).alias("__order"))
    if once:
        asked = asked.groupBy("latitude", "longitude").agg(F.min("__order").alias("__order"))
    rows = results.join(asked, ["latitude", "longitude"]).repartitionByRange("__order").sortWithinPartitions("__order")
    write_table(order_columns(rows.drop("__order")), path, kind)


def key_values(row: DataFrame) -> DataFrame:
    """A one-site result as (tag, metric, value)."""
    tag = F.format_string("lat%.2f_lon%.2f", F.col("latitude"), F.col("longitude"))
    others = [c for c in row.columns if c not in ("latitude", "longitude")]
    return row.select(tag.alias("tag"), *(F.col(c).cast("string").alias(c) for c in others)).unpivot("tag", others, "metric", "value")


def weather_labels(weather: DataFrame) -> DataFrame:
    """Cell weather for export: labels t0, t1, ... and short resource names."""
    return weather.select("cell_id", F.concat(F.lit("t"), F.col("hour_index").cast("string")).alias("t"), F.col("solar").alias("s"), F.col("wind").alias("w"))


def _sheet_rows(name: str, df: DataFrame) -> DataFrame:
    """A table as rows (sheet, cell_id, name, ts, numbers, texts), one for each of its own, with the values of its columns in order."""
    of = lambda texts: F.array(*(F.col(f"`{c}`").cast("string" if texts else "double") for c, t in df.dtypes if c not in SHEET_KEYS and (t == "string") == texts))
    keys = [(F.col(k) if k in df.columns else F.lit(None)).cast(t).alias(k) for k, t in zip(SHEET_KEYS, ("long", "string", "timestamp"), strict=True)]
    return df.select(F.lit(name).alias("sheet"), *keys, of(False).cast("array<double>").alias("numbers"), of(True).cast("array<string>").alias("texts"), F.lit(None).cast("string").alias("columns"))


def write_sheets(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of a detailed result in one job, as one table with a folder for each sheet; read_sheet gives them back.

    A row stays a row, whatever it has in cell_id, name and ts; a table's other columns are numbers or strings, and may be
    any. One more row of each sheet has its schema in columns.
    """
    out = None
    for name, df in tables.items():
        head = df.sparkSession.range(0, 1, 1, 1).select(F.lit(name).alias("sheet"), F.lit(df.schema.json()).alias("columns"))
        rows = _sheet_rows(name, df).unionByName(head, allowMissingColumns=True)
        out = rows if out is None else out.unionByName(rows)
    out.write.mode("overwrite").partitionBy("sheet").parquet(path)


def with_currency(results: DataFrame, currency: str) -> DataFrame:
    """Neutral cost columns renamed to carry the currency: lcoa_per_t to lcoa_eur_per_t."""
    slug = currency.strip().lower()
    renamed = {c: c.replace("_per_t", f"_{slug}_per_t").replace("_per_year", f"_{slug}_per_year") for c in results.columns if c.startswith(("lcoa", "total_cost", "water_cost_per_t", "land_cost_per_t"))}
    return results.withColumnsRenamed(renamed)
