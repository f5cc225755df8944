"""Balanced shards by vector bin packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpoint
from .prefix import running_total, word_count

#: Pools that small groups are gathered in by hash; with the pieces of large groups they are what the packing places.
POOLS = 8192
#: A group of more than a shard's mean bytes over ALONE is placed by itself; one that has to be cut has pieces of these over PIECES.
ALONE, PIECES = 64, 16
#: Shares of a shard that a group may hold whole, tried in this order until no shard is over the mean by more than OVER, or
#: else by more than it is with the smallest pieces.
WHOLE, OVER = (1.0, 0.5, 0.25, 0.125, 1 / PIECES), 0.02
#: Weight of bytes, words and rows in the dot product; bytes are the law that is promised.
WEIGHTS = (4.0, 1.0, 1.0)


def place(units: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit, by descending largest share; a unit goes where the dot product of its vector with the
    residual capacity is highest. units: one row per unit, one column per dimension; a dimension's sum over all units
    is the capacity of all shards together. A dimension that a shard is over in has no residual, and where shards have room
    for the unit's bytes (column 0), the others aren't asked. Ties go to the shard with more room for bytes, then to the lower."""
    share = units / np.maximum(units.sum(axis=0), 1) * shards
    room, where = np.ones((shards, units.shape[1])), np.zeros(len(units), dtype=np.int64)
    for i in np.lexsort((np.arange(len(units)), -share.max(axis=1))):
        score = np.maximum(room, 0) @ (share[i] * WEIGHTS)
        fits = room[:, 0] >= share[i, 0]
        score[~fits] = room[~fits, 0] - 2 if not fits.any() else -np.inf
        best = np.flatnonzero(score >= score.max() - 1e-12)
        where[i] = best[np.argmax(room[best, 0])]
        room[where[i]] -= share[i]
    return where


def place_groups(units: np.ndarray, group: np.ndarray, piece: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit, (bytes, words, rows): the pieces of a group of up to a shard's bytes go together, and those of
    larger groups in as few bundles as hold a shard each. Only where shards would get too unequal, because many groups
    are nearly as large as a shard, may a bundle hold less. Units with piece -1 are no pieces."""
    mean = max(1.0, units[:, 0].sum() / shards)
    keys, which = np.unique(group, return_inverse=True)
    total = np.bincount(which, weights=units[:, 0], minlength=len(keys))

    def tried(most: float) -> tuple[np.ndarray, float]:
        bundles = np.maximum(1, np.ceil(total / (most * mean))).astype(np.int64)[which]
        pairs, member = np.unique(np.stack((which, np.where(piece < 0, -1, piece % bundles)), axis=1), axis=0, return_inverse=True)
        member = member.ravel()
        where = place(np.stack([np.bincount(member, weights=u, minlength=len(pairs)) for u in units.T], axis=1), shards)[member]
        return where, np.bincount(where, weights=units[:, 0], minlength=shards).max()

    finest, least = tried(WHOLE[-1])
    return next((where for where, most in map(tried, WHOLE[:-1]) if most <= max(least, (1 + OVER) * mean)), finest)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", place_in: tuple[Column, Column] | None = None) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for every row of docs; bytes, words and rows are near equal by shard.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes, and its crc32 is that of none. Rows of equal texts
    are a group and share a shard. Only a group of more bytes than a shard is cut, by hashed id, and a smaller one where
    whole groups of that size would leave shards unequal by more than OVER. Groups up to 1 / ALONE of a shard are placed together with others of their text hash, in
    POOLS pools, so the packing places a bounded number of units (POOLS + 2 * shards * ALONE) whatever the input.
    slot counts from 0 without gaps in each shard: in hashed order, or, with place_in, by these columns, a piece of the
    input (such as its file) and the row in the piece. Rows of one id and text get their slots in any order among
    themselves; null ids and repeated rows are rows like others; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), word_count(text).alias("words"), F.xxhash64(text).alias("group"), *((c.alias(n) for c, n in zip(place_in, ("piece_in", "row_in"), strict=True)) if place_in else ()))
    rows = checkpoint(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    alone, most = max(1, total // (shards * ALONE)), max(1, total // (shards * PIECES))
    heavy = rows.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > alone)
    heavy = heavy.select("group", F.ceil(F.col("bytes") / most).cast("int").alias("pieces"))
    rows = rows.join(F.broadcast(heavy), "group", "left")  # fewer than shards * ALONE rows, as each holds more than that part
    cut = F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces"))
    rows = rows.withColumns({"pool": F.when(F.col("pieces").isNull(), F.pmod("group", F.lit(POOLS))).otherwise(F.col("group")), "piece": F.coalesce(cut, F.lit(-1)).cast("int")})

    units = rows.groupBy("pool", "piece").agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")).orderBy("pool", "piece").toPandas()
    units["shard"] = place_groups(units[["size", "words", "rows"]].to_numpy(dtype=float), units["pool"].to_numpy(), units["piece"].to_numpy(), shards)
    placed = docs.sparkSession.createDataFrame(units[["pool", "piece", "shard"]], "pool long, piece int, shard int")
    rows = rows.join(F.broadcast(placed), ["pool", "piece"])
    if place_in:
        pieces = rows.groupBy("shard", "piece_in").agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard").orderBy("piece_in").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.select("shard", "piece_in", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        rows = rows.join(pieces, ["shard", "piece_in"]).withColumn("slot", F.row_number().over(Window.partitionBy("shard", "piece_in").orderBy("row_in", "id")) - 1 + F.col("before"))
    else:
        rows = rows.withColumns({"spread": F.xxhash64("id", "group", F.lit(11)), "one": F.lit(1)})
        rows = running_total(rows, ["shard"], "spread", "one", ["id", "group"], "slot")
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))
