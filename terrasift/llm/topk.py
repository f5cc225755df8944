"""Exact top-k by inner product, without random access.

Candidates are dealt in blocks, queries in blocks, and every pair of blocks is one group. In a group, each dimension is
a list of the candidates sorted by value, read from the end that the sign of the query's component favours. Lists are
read in equal steps. What was read of a candidate, plus the next or the last value of each list that it was not seen in,
bounds its score from above and below. Once few candidates can still reach the k-th lower bound, their scores are
resolved exactly. Bounds of all queries of the block are kept at once, as matrix products over what has been read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of candidates, steps that a list is read in, candidates for each of the k that end the reading.
QUERY_BLOCK, CANDIDATE_BLOCK, STEPS, FEW = 512, 4096, 4, 4
#: Blocks of candidates whose best are merged before those of all blocks are.
MERGE = 256


def block_top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores): at least the k best candidates of each query, its own id left out.

    Whole numbers; scores must fit into 64 bits.
    """
    n, dims = values.shape
    order = np.argsort(values, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    ascending = np.sort(values, axis=0).astype(float)
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    exact = values.astype(float)
    slack = 1e-9 * (np.abs(queries).astype(float) @ np.abs(exact).max(axis=0) + 1) if n else np.zeros(len(queries))
    own = query_ids[:, None] == ids[None, :]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(len(queries))
    for step in range(1, STEPS + 1):
        depth = -(-n * step // STEPS)
        top, low = (rank >= n - depth), (rank < depth)  # seen in lists read from the large end, and from the small end
        u, d = up[active], down[active]
        seen = u @ (exact * top).T + d @ (exact * low).T
        if depth < n:
            next_up, next_down = ascending[n - depth - 1], ascending[depth]
            above = seen + (u * next_up) @ (~top).T + (d * next_down) @ (~low).T
            below = seen + (u * ascending[0]) @ (~top).T + (d * ascending[-1]) @ (~low).T
        else:
            above, below = seen, seen.copy()
        below[own[active]] = -np.inf
        above[own[active]] = -np.inf
        kth = np.partition(below, n - k, axis=1)[:, n - k] if n >= k else np.full(len(active), -np.inf)
        alive = (above >= (kth - slack[active])[:, None]) & ~own[active]
        done = (alive.sum(axis=1) <= FEW * k) | (depth == n)
        for i in np.flatnonzero(done):
            left, q = np.flatnonzero(alive[i]), active[i]
            score = values[left] @ queries[q]
            best = np.lexsort((ids[left], -score))[:k]
            out.append((np.full(len(best), query_ids[q]), ids[left][best], score[best]))
        active = active[~done]
        if not len(active):
            break
    return tuple(np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id_col, score) of the k rows of highest inner product with each query, ties to the smaller id.

    vector_col is an array<bigint>. Every row is a candidate of every query but of that with its own id. A null id or
    vector, an empty vector and one with a null component take no part, and vectors of different lengths have no score
    with each other. Rows of one id count once, with the least vector. Queries without candidates have no rows.
    """
    usable = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull())
    rows = rows.where(usable).groupBy(F.col(id_col).alias("id")).agg(F.min(vector_col).alias("v"), F.max(is_query).alias("q"))
    size, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    query_blocks, blocks = -(-max(asked, 1) // QUERY_BLOCK), -(-max(size, 1) // CANDIDATE_BLOCK)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    dims = F.size("v").alias("dims")
    candidates = rows.select("id", "v", dims, place(blocks, 1).alias("block"), spread(query_blocks).alias("query_block"), F.lit(False).alias("q"))
    queries = rows.where("q").select("id", "v", dims, spread(blocks).alias("block"), place(query_blocks, 2).alias("query_block"), F.lit(True).alias("q"))

    def best(key: tuple, table: pa.Table) -> pa.Table:
        asks = table.column("q").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        values = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        ids, asks = ids[order], asks[order]
        found = block_top_k(ids[asks], values[asks], ids[~asks], values[~asks], k) if asks.any() and not asks.all() else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": found[0], "id": found[1], "score": found[2], "part": np.full(len(found[0]), key[0].as_py() // MERGE, dtype=np.int32)})

    found = candidates.unionByName(queries).groupBy("block", "query_block", "dims").applyInArrow(best, "query_id bigint, id bigint, score bigint, part int")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    found = found.withColumn("rank", rank("query_id", "part")).where(F.col("rank") <= k)
    found = found.withColumn("rank", rank("query_id")).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def scaled_vectors(embeddings: DataFrame, vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """embeddings with a column vector: floor(scale * x) of each component, or null where one is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return embeddings.withColumn("vector", F.when(F.forall(vector_col, finite), whole))
