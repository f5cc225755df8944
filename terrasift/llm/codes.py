"""Compression of vectors to short codes: product quantization in whole numbers, exact, with norm-of-sum bounds.

Each part of a vector belongs to the nearest entry of its codebook. A part remembers lower bounds of its distances to
groups of entries, each with the round in which it was measured. As all codebooks so far are kept, a bound is lowered
later by how far its entries have really come since its own round, the norm of the sum of their moves. The sum of the
norms, that is what one adds up without the history, is never less. Entries are measured again only in groups whose
lowered bound doesn't exceed the distance to the part's own entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import written

#: Whole-number components are held within these ends, so that no sum of squares leaves 64 bits.
MOST = 1 << 26
#: Rows that a task works on at once.
BLOCK = 4096


@dataclass
class Codebooks:
    """history[r]: the entries of round r, parts x entries x width; moves[t]: how far they have come since round t."""

    history: list[np.ndarray]
    groups: int
    moves: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        now = self.history[-1]
        self.moves = np.stack([_ceil_root(((now - then) ** 2).sum(axis=2)) for then in self.history])  # rounds x parts x entries

    @property
    def ends(self) -> np.ndarray:
        """Ends of the groups of neighbouring entries."""
        return np.linspace(0, self.history[-1].shape[1], min(self.groups, max(1, self.history[-1].shape[1])) + 1).astype(int)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.history[-1].ravel().tolist())).encode()).hexdigest()


def _floor_root(square: np.ndarray) -> np.ndarray:
    root = np.sqrt(square.astype(float)).astype(np.int64)
    root -= root * root > square
    return root + ((root + 1) ** 2 <= square)


def _ceil_root(square: np.ndarray) -> np.ndarray:
    root = _floor_root(square)
    return root + (root * root < square)


def _distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, rows x entries, in whole numbers."""
    out = np.zeros((len(rows), len(entries)), dtype=np.int64)
    for k in range(rows.shape[1]):
        out += (rows[:, k, None] - entries[None, :, k]) ** 2
    return out


def first_codes(part: np.ndarray, entries: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(code, squared distance, bounds, stamps) of the first round, in which all is measured."""
    far = _distances(part, entries)
    code = far.argmin(axis=1)
    own = far[np.arange(len(part)), code]
    far[np.arange(len(part)), code] = MOST**2 * 64
    bounds = np.stack([_floor_root(far[:, a:b].min(axis=1)) for a, b in zip(ends[:-1], ends[1:], strict=True)], axis=1)
    return code, own, bounds, np.zeros_like(bounds)


def next_codes(part: np.ndarray, entries: np.ndarray, ends: np.ndarray, moves: np.ndarray, code: np.ndarray, bounds: np.ndarray, stamps: np.ndarray, now: int) -> tuple[np.ndarray, ...]:
    """(code, squared distance, bounds, stamps, measured) of a later round; moves: rounds x entries, since each round.

    A group is measured where its lowered bound isn't over the distance to the own entry. Of equal distances the lower
    index wins, which a bound that is strictly over the distance can't hide.
    """
    old, row = code, np.arange(len(part))
    own = ((part - entries[code]) ** 2).sum(axis=1)
    before, code, measured = own, code.copy(), len(part)
    come = np.stack([moves[:, a:b].max(axis=1) for a, b in zip(ends[:-1], ends[1:], strict=True)], axis=1)  # rounds x groups
    low = np.maximum(bounds - come[stamps, np.arange(len(ends) - 1)], 0)
    asked = low * low <= own[:, None]
    nearest = np.zeros_like(bounds)
    first, second = np.zeros_like(bounds), np.zeros_like(bounds)
    for g, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        rows = np.flatnonzero(asked[:, g])
        if not len(rows):
            continue
        far = _distances(part[rows], entries[a:b])
        measured += far.size
        at = far.argmin(axis=1)
        nearest[rows, g], first[rows, g] = at + a, far[np.arange(len(rows)), at]
        far[np.arange(len(rows)), at] = MOST**2 * 64
        second[rows, g] = far.min(axis=1)
        better = (first[rows, g] < own[rows]) | ((first[rows, g] == own[rows]) & (nearest[rows, g] < code[rows]))
        own = own.copy()
        own[rows[better]], code[rows[better]] = first[rows[better], g], nearest[rows[better], g]
    others = np.where(nearest == code[:, None], second, first)
    group_of_old = np.searchsorted(ends, old, side="right") - 1
    left = np.zeros_like(asked)
    left[row, group_of_old] = (old != code) & ~asked[row, group_of_old]
    bounds = np.where(asked, _floor_root(others), np.where(left, np.minimum(low, _floor_root(before)[:, None]), bounds))
    return code, own, bounds, np.where(asked | left, now, stamps), measured


def _ints(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.minimum(values, 1 << 30).astype(np.int32).ravel())  # a bound may be too low
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _assigned(rows: DataFrame, books: Codebooks, last: bool) -> DataFrame:
    """rows with the code of each part after this round, and bounds and stamps, or after the last round the error."""
    entries, ends, moves, now = books.history[-1], books.ends, books.moves, len(books.history) - 1
    parts, _, width = entries.shape
    groups = len(ends) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                b = batch.slice(at, BLOCK)
                x = _ints(b.column("vector"), parts * width).reshape(len(b), parts, width)
                found = []
                for p in range(parts):
                    if now:
                        code = _ints(b.column("code"), parts)[:, p]
                        state = [_ints(b.column(c), parts * groups)[:, p * groups : (p + 1) * groups] for c in ("bounds", "stamps")]
                        found.append(next_codes(x[:, p], entries[p], ends, moves[:, p], code, *state, now)[:4])
                    else:
                        found.append(first_codes(x[:, p], entries[p], ends))
                code, error, bounds, stamps = (np.stack(f, axis=1) for f in zip(*found, strict=True))
                head = [b.column("id"), b.column("label")]
                if last:
                    text = ["".join(f"{c:02x}" for c in r) for r in code.tolist()]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(text, pa.string()), pa.array(error.sum(axis=1), pa.int64())], ["id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([*head, b.column("vector"), _lists(code), _lists(bounds.reshape(len(b), -1)), _lists(stamps.reshape(len(b), -1))], ["id", "label", "vector", "code", "bounds", "stamps"])

    head = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in ("id", "label"))
    return rows.mapInArrow(run, head + (", code string, error long" if last else ", vector array<int>, code array<int>, bounds array<int>, stamps array<int>"))


def _means(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry's new place: the floor of the mean of its parts; entries without parts stay.

    A task adds up its own rows first, so that the shuffle has a row for each entry and task.
    """
    parts, size, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * size, width), dtype=np.int64), np.zeros(parts * size, dtype=np.int64)
        for batch in batches:
            x = _ints(batch.column("vector"), parts * width).reshape(len(batch) * parts, width)
            place = (_ints(batch.column("code"), parts) + np.arange(parts) * size).ravel()
            counts += np.bincount(place, minlength=parts * size)
            np.add.at(sums, place, x)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), _longs(sums[used])], ["place", "n", "sums"])

    each = rows.select("vector", "code").mapInArrow(run, "place int, n long, sums array<long>")
    totals = each.groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)))
    out = entries.reshape(parts * size, width).copy()
    for r in totals.collect():  # at most parts x entries rows
        out[r.place] = [r[f"s{k}"] // r.n for k in range(width)]
    return out.reshape(entries.shape)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), pa.int64()))


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector): floor(scale * x) of each component, without vectors that are null or hold what is no number."""
    components = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), components.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    held = lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * scale))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(held(x)).cast("int")).alias("vector"))


def compress(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, groups: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """((id_col, label_col, code, error), codebooks): each vector's entries, two hex digits for each part, and its squared
    distance to them.

    Codebooks begin as the parts of the vectors with the smallest ids, of equal ids with the smaller vector, null ids last; with fewer
    vectors than entries they are shorter. Rows may repeat and all count. Vectors are as long as the longest, rounded up
    to a multiple of parts; shorter ones end in zeros. Components beyond 2 ** 26 / scale count as that. No vectors give no
    rows and empty codebooks. Only the three columns are read.

    Each round but the last writes its rows with codes, bounds and stamps to the shared folder, where an executor that
    takes over finds them; the driver holds the codebooks of all rounds, parts x entries x width numbers each.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part, for at most 256 entries")
    rows = whole_vectors(table, id_col, vector_col, label_col, scale)
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts)
    if longest:
        padded = F.concat("vector", F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("vector")))
        rows = rows.withColumn("vector", F.when(F.size("vector") == parts * width, F.col("vector")).otherwise(padded))
    seeds = [r.vector for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    start = np.array(seeds, dtype=np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2) if seeds else np.zeros((parts, 0, width), dtype=np.int64)
    books = Codebooks([start], groups)
    for _ in range(rounds if seeds else 0):
        rows = written(_assigned(rows, books, last=False), "codes")
        books = Codebooks([*books.history, _means(rows, books.history[-1])], groups)
    done = _assigned(rows, books, last=True) if seeds else rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    return done.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def with_label_error(codes: DataFrame, label: str | Column = "label", to: str = "label_error") -> DataFrame:
    """codes with the error added up over all rows of the same label; null is a label.

    Sums are written first, so that the join sees how small they are.
    """
    key = F.col(label) if isinstance(label, str) else label
    codes = written(codes.withColumn("__label", key), "codes")
    sums = written(codes.groupBy(F.col("__label").alias("__of")).agg(F.sum("error").alias(to)), "errors")
    return codes.join(sums, F.col("__label").eqNullSafe(F.col("__of"))).drop("__label", "__of")
