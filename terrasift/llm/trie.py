"""The trie of conversations' beginnings, by truncation peeling.

Peeling starts at the longest conversations. A level's nodes are the sequences of that length, grouped from what ended
there and from the nodes of the level below; then each node loses its last turn and is grouped again, so that counts of
members, children, leaves and repeated text grow on the way up. A turn is known by a hash; texts are never moved.

A level with many rows is grouped by Spark, a row for each node and task going into the shuffle, however many
conversations begin alike. Levels that together hold few rows, as below the usual lengths, are peeled in one round, each
subtree inside one task. A row takes along the keys of some levels only, however long its conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import new_path
from .durable import written

#: Turns that all levels of a round hold together at most, unless it has one level only.
ROUND_TURNS = 1 << 14
#: Levels above the lowest one of a round, or of its neighbours, whose keys a row takes along; when they are used up, the keys
#: of as many more are fetched from the conversation that a node is named after.
STRETCH = 16
#: Lengths up to this have a folder each; longer ones share one with all up to twice as long.
SHELVES = 32
#: Ids that are joined to one string at once.
RUN = 4096

_NODE = "depth long, key binary, parent binary, conv long, n long, children long, leaves long, saved long, path array<binary>, sizes array<int>"


def _turn_key(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def gathered_turns(table: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, key, bytes>>) in order of turn, null first; turns of one number by their keys."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _turn_key(role, text).alias("key"), F.octet_length(text).alias("bytes"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "bytes"))).alias("turns"))


def spliced(convs: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """convs, each with the first h turns of its family's first conversation, conv_id - conv_id % every, in place of its own first h;
    h is crc32 of the id's digits modulo most + 1. Without that conversation its own first h just go."""
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = convs.withColumns({"family": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(heads, "family", "left")
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(convs.schema["turns"].dataType))
    return both.select("conv_id", F.concat(taken, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _paths(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, path, sizes): a key for each beginning of a conversation, made from the one before and the turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for keys in batch.column("keys").to_pylist():
                path, last = [], b""
                for key in keys:
                    path.append(last := hashlib.blake2b(last + key, digest_size=16).digest())
                paths.append(path)
            depth = pa.array([len(p) for p in paths], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), depth, pa.array(paths, pa.list_(pa.binary())), batch.column("sizes")], ["conv_id", "depth", "path", "sizes"])

    flat = convs.select("conv_id", F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    return flat.mapInArrow(run, "conv_id long, depth long, path array<binary>, sizes array<int>")


def _shelf(depth: Column) -> Column:
    return F.when(depth <= SHELVES, depth).otherwise(SHELVES + F.ceil(F.log2(depth / SHELVES))).cast("int")


def rounds(lengths: dict[int, int], most: int = ROUND_TURNS) -> list[tuple[int, int]]:
    """(low, high) of each round, which peels the levels above low up to high, from lengths, the conversations by length."""
    out, alive, turns, high = [], 0, 0, max(lengths, default=0)
    for level in range(high, 0, -1):
        alive += lengths.get(level, 0)
        if turns and turns + alive > most:
            out.append((level, high))
            turns, high = 0, level
        turns += alive
    return [*out, (0, high)] if high else out


def _one_level(rows: DataFrame, level: int, base: int) -> DataFrame:
    """Nodes of rows(path, sizes, conv, n, child, leaves, saved), whose paths all end at level; a path has the keys of the
    levels over base."""
    at = level - base - 1
    nodes = rows.groupBy(F.get("path", F.lit(at)).alias("key")).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("child").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first("path").alias("path"), F.first("sizes").alias("sizes")
    )
    own = (F.col("n") - 1) * F.get("sizes", F.lit(at))
    above = lambda c: F.slice(c, 1, at).alias(c)
    parent = F.get("path", F.lit(at - 1)) if level > 1 else F.lit(None).cast("binary")
    return nodes.select(F.lit(level).cast("long").alias("depth"), "key", parent.alias("parent"), "conv", "n", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"), (F.col("saved") + own).alias("saved"), above("path"), above("sizes"))


def peel(rows: list[tuple], low: int, base: int = 0) -> Iterator[tuple]:
    """Nodes, as _NODE says, of all levels above low, deepest first; rows: (path, sizes, conv, n, child, leaves, saved), whose
    paths have the keys of the levels over base.

    Only nodes of the last level have a path, of the turns that are left.
    """
    waiting: dict[int, dict[bytes, list]] = {}

    def add(depth: int, path: list, sizes: list, conv: int, n: int, child: int, leaves: int, saved: int) -> None:
        node = waiting.setdefault(depth, {}).setdefault(path[depth - base - 1], [path, sizes, conv, 0, 0, 0, 0])
        node[2] = min(node[2], conv)
        for k, x in enumerate((n, child, leaves, saved), 3):
            node[k] += x

    for path, *others in rows:
        add(base + len(path), path, *others)
    for depth in range(max(waiting, default=low), low, -1):
        for key, (path, sizes, conv, n, children, leaves, saved) in waiting.pop(depth, {}).items():
            at = depth - base - 1
            leaves, saved = leaves if children else 1, saved + (n - 1) * sizes[at]
            top = depth == low + 1
            yield depth, key, path[at - 1] if depth > 1 else None, conv, n, children, leaves, saved, path[:at] if top else None, sizes[:at] if top else None
            if not top:
                add(depth - 1, path, sizes, conv, n, 1, leaves, saved)


def _some_levels(rows: DataFrame, low: int, base: int) -> DataFrame:
    """As _one_level for all levels above low: whole subtrees of the first of them meet in a task, which peels them. All
    rows together hold at most ROUND_TURNS turns in these levels."""
    names = ["path", "sizes", "conv", "n", "child", "leaves", "saved"]
    schema = pa.schema([("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("conv", "n", "children", "leaves", "saved")), ("path", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names), strict=True)]
        if nodes := list(peel(mine, low, base)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*nodes, strict=True), schema, strict=True)], schema=schema)

    return rows.repartition(F.get("path", F.lit(low - base))).select(*names).mapInArrow(run, _NODE)


def _peeled(spark: SparkSession, branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of all levels but the root, root) of branches(conv_id, depth, path, sizes, shelf)."""
    lengths = {r.depth: r.n for r in branches.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # a row for each length
    counts = [F.lit(1).cast("long").alias("n"), *(F.lit(0).cast("long").alias(c) for c in ("child", "leaves", "saved"))]
    shelf_of = lambda *depths: spark.range(1).select(*(_shelf(F.lit(d)).alias(str(d)) for d in depths)).first()
    keys = lambda base, high: [F.slice(c, base + 1, high - base).alias(c) for c in ("path", "sizes")]
    folder, below, base = new_path(spark, "trie"), None, None
    for low, high in rounds(lengths):
        shelves = shelf_of(low + 1, high)
        if base is None or base > max(0, low - 1):
            base = max(0, low - STRETCH)
            if below is not None:  # nodes of one level are named after conversations of their own
                longer = branches.where((F.col("shelf") >= shelves[1]) & (F.col("depth") >= high)).select(F.col("conv_id").alias("conv"), *keys(base, high))
                below = below.drop("path", "sizes").join(longer, "conv").select(*below.columns)
        rows = branches.where(F.col("shelf").between(*shelves) & (F.col("depth") > low) & (F.col("depth") <= high)).select(*keys(base, high), F.col("conv_id").alias("conv"), *counts)
        if below is not None:
            rows = rows.unionByName(below)
        nodes = written(_one_level(rows, high, base) if low == high - 1 else _some_levels(rows, low, base), "nodes", folder)
        below = nodes.where(F.col("depth") == low + 1).select("path", "sizes", "conv", "n", F.lit(1).cast("long").alias("child"), "leaves", "saved")
    rows = branches.where("shelf = 0").select("path", "sizes", F.col("conv_id").alias("conv"), *counts)
    root = (rows if below is None else rows.unionByName(below)).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("child").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = root.where("n is not null").select(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("parent"), "conv", "n", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"), "saved")
    nodes = spark.read.schema(_NODE).parquet(f"{folder}/nodes-*") if below is not None else spark.createDataFrame([], _NODE)
    return nodes.drop("path", "sizes"), root


def _ends(branches: DataFrame) -> DataFrame:
    """(key, ends): a digest of the ids that end at each node, in order of the ids, with commas between.

    Ids are dealt by range of node and id, so that those of one node are joined to long strings in many tasks; then the
    strings of a node, one for up to RUN ids, pass one after the other through its digest.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in batches:
            out = []
            for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (k != key or len(ids) == RUN):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(i)
            yield _rows(out, [("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
        if ids:
            yield _rows([(key, ids[0], ",".join(map(str, ids)))], [("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if sha is not None and k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            yield _rows(out, [("key", pa.binary()), ("ends", pa.string())])
        if sha is not None:
            yield _rows([(key, sha.hexdigest())], [("key", pa.binary()), ("ends", pa.string())])

    last = branches.select(F.when(F.col("depth") > 0, F.get("path", F.col("depth").cast("int") - 1)).otherwise(F.lit(b"")).alias("key"), "conv_id")
    runs = last.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(digest, "key binary, ends string")


def _rows(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the conversations convs(conv_id, turns array<struct<turn, key, bytes>>).

    conv_id: the smallest member, a conversation that begins so; depth: its number of turns; parent_conv_id: of the
    beginning one turn shorter, null at the root, which has no turns; n_convs: members; n_children; n_leaves: beginnings
    without children in the subtree, itself included; saved_tokens: bytes of text in the subtree that stand in more than
    one member, once less than there are members; ends_sha256: of the members that end there, as decimal numbers in order
    with commas between, and of nothing if there are none.

    Conversations without turns are members of the root alone. No conversations give no rows. conv_id must be unique and
    not null. A conversation's keys, not its texts, are one row.
    """
    spark = convs.sparkSession
    folder = new_path(spark, "branches")
    _paths(convs).withColumn("shelf", _shelf(F.col("depth"))).write.partitionBy("shelf").parquet(folder)
    branches = spark.read.schema("conv_id long, depth long, path array<binary>, sizes array<int>, shelf int").parquet(folder)
    nodes, root = _peeled(spark, branches)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    first = nodes.where("depth = 1").crossJoin(root.select(F.col("conv").alias("parent_conv_id")))  # one row
    placed = nodes.where("depth > 1").join(parents, "parent").unionByName(first).unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long")))
    found = placed.join(_ends(branches), "key", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"))


def conversation_trie(table: DataFrame) -> DataFrame:
    """The trie of table(conv_id, turn, role, text), after each conversation got the first turns of its family's first one.

    Null roles and texts are empty; rows without a conv_id are no conversation; turns of one number stand in order of
    their hashes, and repeated rows are turns. Other columns aren't read.
    """
    return prefix_trie(spliced(written(gathered_turns(table), "conversations")))
