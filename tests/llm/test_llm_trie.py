"""The trie of conversations: against brute force on odd tables, with many and with few rounds."""

import hashlib
import random
import zlib

import pytest

from terrasift.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth string, path string"


def by_force(rows):
    """Nodes of all beginnings, by comparing all with all."""
    convs = {}
    for i, turn, role, text in rows:
        if i is not None:
            role, text = role or "", text or ""
            convs.setdefault(i, []).append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    convs = {i: [t[2:] for t in sorted(v)] for i, v in convs.items()}
    built = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(int(c / 5) * 5, [])[:h] + convs[c][h:])
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(built[c][:d], []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = lambda k: [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in members if len(built[c]) == len(key))
        out.append((members[0], len(key), nodes[key[:-1]][0] if key else None, len(members), len(children(key)), sum(not children(k) for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def compared(spark, rows):
    wide = [(*r, "k", "d", "p") for r in rows]
    frame = trie.conversation_trie(spark.createDataFrame(wide, SCHEMA).repartition(3))
    order = lambda x: tuple(-1 if v is None else v for v in x)
    got = sorted((tuple(r) for r in frame.collect()), key=order)
    assert got == sorted(by_force(rows), key=order)
    return got


def odd_rows(seed=1):
    r = random.Random(seed)
    texts = ["a", "b", "é" * 3, "", None, "same", "long " * 40]
    rows = []
    for c in range(60):
        first = [("system", "you are"), ("user", "hello")] if c % 3 else []
        turns = first + [(r.choice(["user", "bot", None]), r.choice(texts)) for _ in range(r.choice([0, 1, 2, 5, 9, 12]))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    for c in (100, 101, 102, 103, 105, 106, 110):  # copies
        rows += [(c, k, "user", f"copy {k}") for k in range(11)]
    rows += [(200, None, "user", "no number"), (200, 0, "bot", "x"), (200, 1, "bot", "x"), (201, 1, "bot", "x")]
    rows += [(300, k, "bot", f"deep {k}") for k in range(120)] + [(301, k, "bot", f"deep {k}") for k in range(90)]  # longer than all others
    rows += [rows[5], rows[5], (7, 3, "user", "more"), (7, 3, "user", "more"), (None, 0, "user", "no conversation"), (-6, 0, "u", "below zero"), (-5, 0, "u", "below zero")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("most, stretch", [(1, 16), (1, 3), (200, 2), (1 << 14, 16)])
def test_odd_conversations(spark, monkeypatch, most, stretch):
    monkeypatch.setattr(trie.rounds, "__defaults__", (most,))
    monkeypatch.setattr(trie, "STRETCH", stretch)
    if most == 1:  # a round for each level
        rows = [r for r in odd_rows() if r[0] is None or r[0] < 300]
    else:
        rows = odd_rows()
    compared(spark, rows)


def test_none_and_turnless(spark):
    assert compared(spark, []) == []
    turnless = next(c for c in range(1, 5000) if zlib.crc32(str(c).encode()) % 9 >= 2 and c % 5)
    compared(spark, [(turnless, 0, "u", "goes")])  # no family: its first turns go and none come
    compared(spark, [(5, 0, None, None), (5, 0, None, None)])


def test_rounds_cover_all_levels_once():
    lengths = {1: 500, 2: 300, 5: 100, 40: 3, 400: 1}
    found = trie.rounds(lengths, 1000)
    levels = [d for low, high in found for d in range(high, low, -1)]
    assert levels == list(range(400, 0, -1))
    alive = lambda d: sum(n for k, n in lengths.items() if k >= d)
    assert all(high - low == 1 or sum(map(alive, range(low + 1, high + 1))) <= 1000 for low, high in found)
    assert trie.rounds({}) == [] == trie.rounds({0: 9}) and len(found) < 8


def test_ids_of_a_node_in_many_runs(spark, monkeypatch):
    """Ids that end together are joined in runs, and their order holds over runs."""
    monkeypatch.setattr(trie, "RUN", 7)
    compared(spark, [(5 * c, 0, "u", "t") for c in range(1, 120)])
