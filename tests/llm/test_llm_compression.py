"""Vector codes: against brute force, on odd tables, and how much the bounds save."""

import hashlib
import math
import random

import numpy as np
import pytest

from terrasift.llm import codes
from terrasift.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_force(rows, parts=16, entries=64, rounds=2, scale=256):
    """(codes and errors by row, final books), with plain whole numbers; rows: (id, vector, label), kept as they come."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[v[p * width : p * width + width] for _, v, _ in first] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            row = []
            for p, book in enumerate(books):
                part = v[p * width : p * width + width]
                row.append(min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book)))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * width : p * width + width] for (_, v, _), row in zip(kept, found, strict=True) if row[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, "".join(f"{k:02x}" for _, k in row), sum(d for d, _ in row), label) for (i, _, label), row in zip(kept, assign(), strict=True)], books


def compared(spark, rows, **options):
    frame, books = codes.compress(spark.createDataFrame(rows, SCHEMA), **options)
    want, force = by_force(rows, **{k: v for k, v in options.items() if k != "groups"})
    got = [(r.vec_id, r.code, r.error, r.label) for r in frame.collect()]
    order = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    assert sorted(got, key=order) == sorted(want, key=order)
    if want:
        assert books.history[-1].tolist() == force
    return frame


def test_odd_tables(spark):
    random.seed(4)
    v = lambda n=8: [random.uniform(-1, 1) for _ in range(n)]
    rows = [(k, v(), k % 3) for k in range(40)] + [(7, v(), None), (7, v(), 1), (None, v(), 1)]
    rows += [(50, None, 1), (51, [0.1, None], 1), (52, [math.nan] * 8, 1), (53, [math.inf] * 8, 1), (54, v(5), 2), (55, [], 2)]
    rows += [(60 + k, [0.25] * 8, 9) for k in range(20)]  # ties and repeated rows
    compared(spark, rows, parts=4, entries=6)
    compared(spark, rows, parts=4, entries=6, rounds=5, groups=2)
    compared(spark, rows[:3], parts=4, entries=64)  # fewer vectors than entries
    compared(spark, [(1, [], 1)], parts=4)
    compared(spark, [(1, [3e38] * 4, 1), (2, [-3e38] * 4, None)][:0], parts=4)
    far, _ = codes.compress(spark.createDataFrame([(1, [3e38] * 4, 1), (2, [-3e38] * 4, None)], SCHEMA), parts=4)
    assert {r.error for r in far.collect()} == {0}
    with pytest.raises(ValueError, match="256"):
        codes.compress(spark.createDataFrame([], SCHEMA), entries=300)


def test_label_errors_and_other_columns(spark):
    rows = [(k, [k / 9.0, -k / 7.0], None if k % 4 == 0 else k % 4, "x", "y") for k in range(30)]
    table = spark.createDataFrame(rows, f"{SCHEMA}, code string, bounds string")
    got = codes.with_label_error(codes.compress(table, parts=2, entries=4)[0]).collect()
    want, _ = by_force([r[:3] for r in rows], parts=2, entries=4)
    total = {}
    for _, _, error, label in want:
        total[label] = total.get(label, 0) + error
    assert sorted((r.vec_id, r.error, r.label_error) for r in got) == sorted((i, e, total[label]) for i, _, e, label in want)


def test_registered_query(spark, data):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want, books = by_force(rows)
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    got = QUERIES["op12_vector_code_compression"](spark, data).collect()
    assert {r.codebooks_sha256 for r in got} == {digest} and sorted((r.vec_id, r.code, r.error) for r in got) == sorted(w[:3] for w in want)


def rounds_of(part, entries, groups, rounds, net=True):
    """Distances measured in each round but the first, codes checked against brute force; without net, the moves are added up."""
    history, measured, drift = [entries], [], None
    books = codes.Codebooks([entries[None]], groups)
    code, _, bounds, stamps = codes.first_codes(part, entries, books.ends)
    for now in range(1, rounds + 1):
        history.append(np.array([part[code == k].sum(axis=0) // (code == k).sum() if (code == k).any() else history[-1][k] for k in range(len(entries))]))
        books = codes.Codebooks([h[None] for h in history], groups)
        if net:
            moves = books.moves[:, 0]
        else:
            step = codes._ceil_root(((history[-1] - history[-2]) ** 2).sum(axis=1))
            drift = np.concatenate((step[None] if drift is None else drift + step, np.zeros((1, len(entries)), dtype=np.int64)))
            assert (drift >= books.moves[:, 0]).all()
            moves = drift
        code, own, bounds, stamps, n = codes.next_codes(part, history[-1], books.ends, moves, code, bounds, stamps, now)
        far = codes._distances(part, history[-1])
        assert (code == far.argmin(axis=1)).all() and (own == far.min(axis=1)).all()
        measured.append(n)
    return measured


def test_bounds_save_distances_and_net_moves_save_more():
    rng = np.random.default_rng(8)
    part = np.floor(256 * (rng.normal(size=(3000, 4)) * 0.1 + rng.integers(0, 12, 3000)[:, None] * 0.4)).astype(np.int64)
    entries = part[:64]
    net, summed = rounds_of(part, entries, 8, 12), rounds_of(part, entries, 8, 12, net=False)
    assert all(n < 0.7 * part.shape[0] * 64 for n in net[2:]) and sum(net) < sum(summed)


def test_roots():
    for n in (0, 1, 2, 3, 4, 8, 9, (1 << 54) - 1, 1 << 54, (1 << 54) + 1):
        x = np.array([n])
        assert codes._floor_root(x)[0] == math.isqrt(n) and codes._ceil_root(x)[0] == math.isqrt(n - 1) + 1 if n else codes._ceil_root(x)[0] == 0
