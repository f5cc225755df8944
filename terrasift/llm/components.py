"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpoint

#: Up to this many edges that are left are contracted in one task, instead of in further rounds.
FEW_EDGES = 50_000


def _last_hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node reachable from each node of few edges."""
    ends = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
    nodes, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        least = least[least[root]]
        if (least == root).all():
            break
        root = least
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def contract(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Each round hooks every node to the least neighbour (or itself) and contracts the graph. Nodes are longs that should be
    well spread, such as hashes: in random order a constant share of the nodes goes in a round whatever the graph's
    shape, and a star whose centre is its least node goes in one. All steps are partial aggregations and equi joins; a
    hub's row count never gathers in one group. The last FEW_EDGES edges are contracted in one task. Loops are allowed and
    make their node known; nulls are ignored.
    """
    current, hops = checkpoint(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna().distinct()), []
    while current.count() > FEW_EDGES:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hops.append(checkpoint(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))))
        first = hops[-1].select(F.col("node").alias("a"), F.col("root").alias("ra"))
        second = hops[-1].select(F.col("node").alias("b"), F.col("root").alias("rb"))
        current = current.join(first, "a").join(second, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        current = checkpoint(current.distinct())
    hops.append(checkpoint(current.coalesce(1).mapInArrow(_last_hop, "node bigint, root bigint")))
    known = hops[0]
    for hop in hops[1:]:
        step = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
        known = known.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return known.withColumnRenamed("root", "component")


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """contract for longs that needn't be well spread, such as ids: it works on their hashes, which differ where they do."""
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna()
    names = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("hash", F.xxhash64("node"))
    found = contract(pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), "a", "b").withColumnRenamed("node", "hash")
    found = names.join(found, "hash").select("node", F.col("component").alias("root"))
    return found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
