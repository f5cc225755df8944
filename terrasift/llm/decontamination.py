"""Benchmark decontamination: word windows of benchmark items inside documents.

A prefix-filtered containment join. A window occurs only if all its shingles do, so one shingle, its prefix, is
enough to look for: the one that is rarest over all documents. Documents and windows are joined by it. Where a document
has that shingle, the bounds follow from its place: the window must begin at or after the document's first word and
end at or before its last one. What is left is verified word by word.

Documents are read twice, however many items there are: to count shingles, and to find prefixes. Tasks hold a bitmap of
the shingles that are asked for, so that few others are shuffled; its size is bounded, and shingles that it lets through
meet nothing in the join. A hit takes its neighbouring words along, so texts aren't fetched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import small_batches, spare_name, written
from .words import ALNUM, Words, text_chunks, window_hashes

SHINGLE = 3
#: Bits that a bitmap has for each shingle, and the most that it has; it is 32 MB at most.
BITS_EACH, MOST_BITS = 16, 1 << 28
_HITS = "shingle array<bigint>, pos array<int>, lead array<int>, around array<string>"


def _parts(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins and ends therein."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    line = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
    inside = np.flatnonzero(words.kind)
    line[np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)] = words.data[inside]
    return line.tobytes(), end - size, end


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, and so on, size[i] of them, for each i."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else first, size) + np.arange(size.sum())


def _item_windows(width: int):
    """Rows of all windows of items: name, text, number of words, and shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column("text")):
                words = Words(data, offsets, ALNUM, lower=True)
                line, start, end = _parts(words)
                hashes, sizes = words.hashes(), np.minimum(words.counts, width)
                many = np.where(sizes > 0, words.counts - sizes + 1, 0)
                begin, size = _runs(words.first[:-1], many), np.repeat(sizes, many)
                short = np.minimum(size, SHINGLE)
                at = np.concatenate(([0], np.cumsum(size - short + 1)))
                values = np.empty(at[-1], dtype=np.uint64)
                for w in np.unique(short):
                    own = np.flatnonzero(short == w)
                    number = size[own] - w + 1
                    values[_runs(at[own], number)] = window_hashes(hashes, int(w))[_runs(begin[own], number)]
                names = batch.column("name").slice(low, high - low).take(pa.array(np.repeat(np.arange(high - low), many)))
                texts = [line[a:b].decode() for a, b in zip(start[begin].tolist(), end[begin + size - 1].tolist(), strict=True)]
                shingles = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([names, pa.array(texts, pa.string()), pa.array(size, pa.int32()), shingles], ["name", "text", "size", "shingles"])

    return run


def _bitmap(keys: DataFrame, number: int) -> Broadcast:
    """A bitmap of the longs in keys, which are about number; it may take others for them, but misses none."""
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS_EACH * number).bit_length()))
    slot = F.col("shingle").bitwiseAND(F.lit(bits - 1))
    cells = keys.select(F.shiftright(slot, 6).alias("cell"), F.expr("shiftleft(1L, cast(shingle & 63 as int))").alias("bit"))
    cells = cells.groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.uint64)
    table[cells.column("cell").to_numpy()] = cells.column("bit").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def _places(words: Words, bitmap: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of shingles of some width that the bitmap has; none crosses texts."""
    found = window_hashes(words.hashes(), width)
    slot = found & np.uint64(64 * len(bitmap) - 1)
    hit = np.flatnonzero((bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
    row = words.row_of_word()
    hit = hit[row[hit] == row[hit + width - 1]]
    return hit, found[hit]


def _count(bitmap: Broadcast, widths: list[int]):
    """How often documents have the shingles that the bitmap has, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                words = Words(data, offsets, ALNUM, lower=True)
                key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_places(words, bitmap.value, w)[1] for w in widths)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return run


def _find(bitmap: Broadcast, widths: list[int], width: int):
    """Each row without its text, with its number of words and the prefixes found, each with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column("text")):
                words = Words(data, offsets, ALNUM, lower=True)
                found = [(*_places(words, bitmap.value, w), w) for w in widths]
                pos = np.concatenate([np.zeros(0, np.int64), *(p for p, _, _ in found)])
                key = np.concatenate([np.zeros(0, np.uint64), *(k for _, k, _ in found)])
                # A shingle shorter than others is a whole window.
                reach = np.concatenate([np.zeros(0, np.int64), *(np.full(len(p), width if w == SHINGLE else w) for p, _, w in found)])
                back = np.concatenate([np.zeros(0, np.int64), *(np.full(len(p), max(width - w, 0) if w == SHINGLE else 0) for p, _, w in found)])
                order = np.argsort(pos, kind="stable")
                pos, key, reach, back = pos[order], key[order], reach[order], back[order]
                row = words.row_of_word()[pos]
                first = words.first[row]
                begin, stop = np.maximum(first, pos - back), np.minimum(words.first[row + 1], pos + reach)
                around: list[str] = []
                if len(pos):
                    line, start, end = _parts(words)
                    around = [line[a:b].decode() for a, b in zip(start[begin].tolist(), end[stop - 1].tolist(), strict=True)]
                at = pa.array(np.searchsorted(row, np.arange(high - low + 1)), pa.int32())
                values = [pa.array(key.view(np.int64)), pa.array(pos - first, pa.int32()), pa.array(pos - begin, pa.int32()), pa.array(around, pa.string())]
                kept = [(n, c.slice(low, high - low)) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
                lists = zip(("shingle", "pos", "lead", "around"), (pa.ListArray.from_arrays(at, v) for v in values), strict=True)
                names, arrays = zip(*kept, ("n_words", pa.array(words.counts, pa.int64())), *lists, strict=True)
                yield pa.RecordBatch.from_arrays(list(arrays), list(names))

    return run


def _digests(text: Column) -> tuple[Column, Column]:
    """128 bits that tell texts apart."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _occurrences(docs: DataFrame, items: DataFrame, item_col: str, item_text: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For docs of columns h1, h2 (the digests of the text), text and maybe more: the rows of docs without their texts,
    with their number of words and the prefixes found; (h1, h2, begin, end, w1, w2) of occurrences of windows, once for
    equal texts; and (w1, w2, name) of the items' windows."""
    small_batches(docs.sparkSession)
    items = items.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((item_col, "name"), (item_text, "text"))))
    windows = items.mapInArrow(_item_windows(width), "name string, text string, size int, shingles array<bigint>")
    windows = written(windows.withColumns(dict(zip(("w1", "w2"), _digests(F.col("text")), strict=True))), "windows")
    widths, number = windows.agg(F.sort_array(F.collect_set(F.least("size", F.lit(SHINGLE)))), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()

    asked = windows.select("w1", "w2", F.posexplode("shingles").alias("at", "shingle"))
    texts = docs.select("text").mapInArrow(_count(_bitmap(asked, number), widths), "shingle bigint, n bigint")
    counts = texts.groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at"))
    prefixes = asked.join(counts, "shingle", "left").groupBy("w1", "w2").agg(rarest.alias("p")).where(F.col("p.n") > 0)
    prefixes = prefixes.join(windows.select("w1", "w2", F.col("text").alias("window"), "size").distinct(), ["w1", "w2"])
    prefixes = written(prefixes.select("p.shingle", "p.at", "window", "size", "w1", "w2"), "prefixes")

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    find = _find(_bitmap(prefixes, prefixes.count()), widths, width)
    found = written(docs.mapInArrow(find, f"{kept}, n_words bigint, {_HITS}"), "found")
    hits = found.select("h1", "h2", F.inline(F.arrays_zip("shingle", "pos", "lead", "around"))).distinct()
    begin = F.col("lead") - F.col("at")
    words = F.split("around", " ")
    hits = hits.join(prefixes, "shingle").where((begin >= 0) & (begin + F.col("size") <= F.size(words)))
    hits = hits.where(F.array_join(F.slice(words, F.greatest(begin, F.lit(0)) + 1, F.col("size")), " ") == F.col("window"))
    first = F.col("pos") - F.col("at")
    spans = hits.select("h1", "h2", first.alias("begin"), (first + F.col("size")).alias("end"), "w1", "w2")
    return found, written(spans, "spans"), windows.select("w1", "w2", "name")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """(id_col, n_words, starts, ends, items) for every row of docs.

    Words are runs of anything but ASCII other than letters and digits, A to Z lower-cased. A window is width
    consecutive words of an item; an item of fewer words, but not none, is one window. starts and ends are the hit
    stretches of words (end exclusive), items the sorted ids, as strings, of the items with windows in the text.
    A null text has no words; a null item id is the empty string; items of one id are one item; rows of docs may
    repeat. No items: nothing is hit. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2 = _digests(text)
    rows = docs.select(F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), text.alias("text"))
    found, spans, owners = _occurrences(rows, items, item_col, item_text, width)

    order = Window.partitionBy("h1", "h2").orderBy("begin", "end")
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stretches = spans.select("h1", "h2", "begin", "end").distinct().withColumn("new", (last.isNull() | (F.col("begin") > last)).cast("int"))
    stretches = stretches.withColumn("stretch", F.sum("new").over(order)).groupBy("h1", "h2", "stretch").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    stretches = stretches.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("s"))
    names = spans.select("h1", "h2", "w1", "w2").distinct().join(owners, ["w1", "w2"]).select("h1", "h2", "name").distinct()
    names = names.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("name")).alias("items"))
    # Written, so that the join below sees its size: it is broadcast if small, and else keys of many equal texts are split.
    named = written(stretches.join(names, ["h1", "h2"]), "leaks")

    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    out = lambda s, e, i: (F.col("id").alias(id_col), "n_words", none(s, "int").alias("starts"), none(e, "int").alias("ends"), none(i, "string").alias("items"))
    some = found.where(F.size("shingle") > 0).select("id", "n_words", "h1", "h2").join(named, ["h1", "h2"], "left")
    nothing = F.lit(None)
    return some.select(*out(F.col("s.begin"), F.col("s.end"), F.col("items"))).unionByName(found.where(F.size("shingle") == 0).select(*out(nothing, nothing, nothing)))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of any item; see find_contamination."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2 = _digests(text)
    _, spans, _ = _occurrences(docs.select(h1.alias("h1"), h2.alias("h2"), text.alias("text")), items, item_col, item_text, width)
    own = spare_name(docs, "h1"), spare_name(docs, "h2")
    hit = spans.select(F.col("h1").alias(own[0]), F.col("h2").alias(own[1])).distinct()
    return docs.withColumns({own[0]: h1, own[1]: h2}).join(hit, list(own), "left_anti").select(*(f"`{c}`" for c in docs.columns))
