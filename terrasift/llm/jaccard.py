"""N-gram Jaccard join of whole documents: components of the graph of near copies.

The method, exact from end to end:

1. A document is the set of its distinct word shingles. Equal sets form one class; a class takes part once, however
   many copies it has.
2. Extended prefixes: a set of n shingles that reaches the threshold with another shares at least ``l`` of its
   first ``n - ceil(t n) + l`` shingles in hash order. Those prefixes, and no more, are dealt out by shingle to find
   which of their shingles other classes share, and how many classes (its frequency).
3. A class with fewer shared prefix shingles than any partner needs is done. The others order their shared ones by
   rarity and keep the shortest prefix that must hit a partner: a rare shingle is a signature by itself; frequent
   ones fall into classes, where every combination of k = 2 is a signature, so a class of c frequent shingles
   survives c - 2 misses and the prefix is extended until the survivals exceed the misses a partner can cause.
4. Classes that share a signature form a group with all that they reach that way; groups are verified with exact
   intersection counts. A group above a size is cut in blocks of sets about as large: each block is verified by itself,
   then one set of every component of a block meets the other blocks of its size, and only where that leaves several
   larger components do the rest of their sets. Sets first meet as bitmaps of two to four bits a shingle, which bound
   what two sets can share; only where a set may have a partner in a block do its shingles go there.

A shingle that very many classes have in their prefix is told by counting in each batch; its entries need no counting
and are dealt by class. Shingles are 64-bit hashes; sets are told apart by 128 bits, of which prefixes take the first 64
along if these differ for all classes. Of texts nothing is moved but the shingles of those that a group asks for, which a
bitmap of bounded size tells from most others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import contract
from .decontamination import _bitmap
from .durable import checkpoint, small_batches, spare_name
from .words import NOT_SPACE, Words, mix, shingle_sets, text_chunks

#: From this many classes on, a shingle counts as frequent and is used in combinations only.
FREQUENT = 64
#: A prefix is extended by this part of the set.
EXTENSION = 8
#: Shingles of sets whose prefixes make one bucket, and shingles that one block of a group may hold.
BUCKET_SHINGLES, BLOCK_SHINGLES = 4_000_000, 100_000
#: Bytes of bitmaps that make one row, and words of them that are compared at once.
PACK_BYTES, STEP_WORDS = 16_384, 1_000_000
#: Bits, 64 in a row that is broadcast, that tell most rows that stay from those that go, which alone are shuffled.
MARKS = 1 << 24
#: A shingle is hot with at least one in HOT_SHARE of all prefix entries, and at least HOT_LEAST of them.
HOT_SHARE, HOT_LEAST = 4096, 1024


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


class _Rule:
    """Bounds that follow from the threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - _ceil(self.num * n, self.den) + max(1, n // EXTENSION)

    def least_shared(self, n: int) -> int:
        """Shared prefix shingles that any partner of a set of n needs at least."""
        return max(1, _ceil(self.num * n, self.den) // EXTENSION)

    def bands(self, n: int) -> list[int]:
        """The size bands (powers of two) that a set of n meets partners in: its own, and the next if one may lie there."""
        own = n.bit_length() - 1
        return [own] + [own + 1] * (n * self.den // self.num >= 2 << own)

    def size_step(self) -> float:
        """Partners of a set lie in its own step of sizes or in a neighbouring one, if each is so many times the last."""
        return max(2**0.5, 1.001 * self.den / self.num)

    def token_classes(self, band: int) -> int:
        """Classes of frequent shingles in a band, few enough that every prefix can be extended to full coverage."""
        smallest = _ceil(self.num << band, self.den)
        return max(0, self.least_shared(smallest) - 1)


def _set_hash(values: np.ndarray) -> bytes:
    """128 bits of a set of shingles."""
    with np.errstate(over="ignore"):
        one = np.bitwise_xor.reduce(mix(values + np.uint64(0x51ED))) + values.sum(dtype=np.uint64)
        two = mix(values ^ np.uint64(0xA5A5_0F0F_3C3C_9696)).sum(dtype=np.uint64) + np.uint64(len(values))
        return mix(np.array([one, two], dtype=np.uint64)).tobytes()


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of a batch with a column text, chunk by chunk."""
    for low, high, data, offsets in text_chunks(batch.column("text")):
        values, first = shingle_sets(Words(data, offsets, NOT_SPACE, lower=True), width)
        for i in range(high - low):
            yield low + i, values[first[i] : first[i + 1]]


def _profile(width: int, rule: _Rule):
    """A row for each text; and for each shingle that is common in a batch's prefixes one without a node, its count in n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, prefixes = [b""] * len(batch), np.zeros(len(batch), dtype=np.int64), {}
            for row, values in _sets(batch, width):
                size[row] = len(values)
                if len(values):
                    node[row] = _set_hash(values)
                    prefixes.setdefault(node[row], values[: rule.prefix(len(values))].copy())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(node, pa.binary()), pa.array(size)], ["id", "th", "node", "n"])
            entries = np.concatenate([np.zeros(0, np.uint64), *prefixes.values()])
            token, count = np.unique(entries, return_counts=True)
            common = count >= max(2, len(entries) / HOT_SHARE)
            token, count = token[common].view(np.int64), count[common].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(token), pa.int64()), pa.array(token), pa.nulls(len(token), pa.binary()), pa.array(count)], ["id", "th", "node", "n"])

    return run


def _name_words(classes: DataFrame) -> int:
    """Words of 64 bits of their hashes that tell the classes apart."""
    first, every = classes.agg(F.count_distinct(F.substring("node", 1, 8)), F.count("*")).first()
    return 1 if first == every else 2


def _prefixes(width: int, rule: _Rule, buckets: int, hot: np.ndarray, name_words: int):
    """Rows of one bucket and one batch: the prefix shingles in it of the batch's classes, each class once. Hot shingles
    lie in buckets of their own, dealt by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, np.ndarray] = {}
            for _, values in _sets(batch, width):
                if len(values) and (node := _set_hash(values)) not in found:
                    found[node] = values[: rule.prefix(len(values))].copy()
            if not found:
                continue
            ids = np.frombuffer(b"".join(found), dtype=np.uint64).reshape(-1, 2)[:, :name_words]
            tokens, owner = np.concatenate(list(found.values())), np.repeat(np.arange(len(ids)), [len(p) for p in found.values()])
            bucket = (mix(tokens) % np.uint64(buckets)).astype(np.int32)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
                bucket[is_hot] = buckets + (ids[owner[is_hot], 0] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            tokens, owner, bucket = tokens[order], owner[order], bucket[order]
            cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            rows = []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                who, count = np.unique(owner[low:high], return_counts=True)
                rows.append((int(bucket[low]), ids[who].tobytes(), count.astype(np.int32).tobytes(), tokens[low:high].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "nodes", "counts", "tokens"])

    return run


def _shared(buckets: int, hot: np.ndarray, hot_count: np.ndarray, name_words: int):
    """The prefix shingles of a bucket that at least two classes have, with the number of classes (of hot ones, a bound)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x, dtype=t) for x in table.column(c).to_pylist()])
        node, token = np.repeat(read("nodes", np.uint64).reshape(-1, name_words), read("counts", np.int32), axis=0), read("tokens", np.uint64)
        order = np.lexsort((*node.T, token))
        node, token = node[order], token[order]
        keep = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1]).any(axis=1)))
        node, token = node[keep], token[keep]
        if key[0].as_py() >= buckets:
            frequency = hot_count[np.searchsorted(hot, token)]
        else:
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            frequency = np.diff(np.append(start, len(token)))
            frequency = np.repeat(frequency, frequency)
        keep = frequency > 1
        nodes = np.ascontiguousarray(node[keep])
        nodes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * name_words), len(nodes), [None, pa.py_buffer(nodes.tobytes())]).cast(pa.binary())
        return pa.table({"node": nodes, "token": token[keep].view(np.int64), "df": np.minimum(frequency[keep], 2**31 - 1).astype(np.int32)})

    return run


def signatures(tokens: np.ndarray, frequency: np.ndarray, n: int, rule: _Rule, frequent: int = FREQUENT) -> np.ndarray:
    """Signatures of a set of n from its shared prefix shingles and their frequencies."""
    spare = len(tokens) - rule.least_shared(n)
    if spare < 0:
        return np.zeros(0, dtype=np.uint64)
    order = np.lexsort((tokens, frequency))
    tokens, frequency = tokens[order], frequency[order]
    rare = int(np.searchsorted(frequency, frequent))
    single = tokens[: min(rare, spare + 1)]
    need, rest = spare + 1 - len(single), tokens[rare:]
    if need <= 0:
        return single
    out = [single]
    for band in rule.bands(n):
        classes = rule.token_classes(band)
        if classes < 1:
            out.append(rest[:need])
            continue
        kind = (mix(rest) % np.uint64(classes)).astype(np.int64)
        groups: dict[int, list[int]] = {}
        covered = 0
        for token, k in zip(rest.tolist(), kind.tolist(), strict=True):
            group = groups.setdefault(k, [])
            covered += bool(group)
            group.append(token)
            if covered >= need:
                break
        pairs = np.array([p for g in groups.values() for p in combinations(sorted(g), 2)], dtype=np.uint64).reshape(-1, 2)
        with np.errstate(over="ignore"):
            out.append(mix(mix(pairs[:, 0]) * np.uint64(3) + pairs[:, 1] + np.uint64(band)))
    return np.unique(np.concatenate(out))


def _signature_rows(rule: _Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = batch.column("n").to_numpy(), batch.column("node").to_numpy()
            tokens, frequency = batch.column("tokens"), batch.column("dfs")
            flat_t, flat_f = tokens.flatten().to_numpy().view(np.uint64), frequency.flatten().to_numpy()
            at = np.concatenate(([0], np.cumsum(tokens.value_lengths().to_numpy())))
            found = [signatures(flat_t[at[i] : at[i + 1]], flat_f[at[i] : at[i + 1]], int(sizes[i]), rule) for i in range(len(batch))]
            lengths = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)), pa.array(np.repeat(nodes, lengths))], ["sig", "node"])

    return run


def _tokens(width: int, asked: Broadcast):
    """The sets of texts whose hash the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("th").to_numpy().view(np.uint64) & np.uint64(64 * len(asked.value) - 1)
            batch = batch.filter(pa.array(((asked.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)))
            found = [None] * len(batch)
            for row, values in _sets(batch, width):
                found[row] = values.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(found, pa.binary())], ["id", "th", "tokens"])

    return run


class _Index:
    """Sets by shingle, to count what one set has in common with each."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        self.token, self.start = flat[start], np.append(start, len(flat))

    def near(self, values: np.ndarray, num: int, den: int) -> np.ndarray:
        """The sets with a similarity of num / den or more to values."""
        at = np.minimum(np.searchsorted(self.token, values), len(self.token) - 1)
        at = at[self.token[at] == values]
        size = self.start[at + 1] - self.start[at]
        entry = np.repeat(self.start[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(at) else at
        common = np.bincount(self.owner[entry], minlength=len(self.n))
        return np.flatnonzero(den * common >= num * (self.n + len(values) - common))


def verify(sets: list[np.ndarray], num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (pairs of positions) that connect whatever a link of similarity num / den or more connects, and the component
    of each position.

    Sweeps pivots: a pivot's exact intersection with every set comes from an inverted index. It ends once all sets
    that were no pivot lie in one component, so that every pair across components has been counted.
    """
    index, label, open_, links = _Index(sets), np.arange(len(sets)), np.ones(len(sets), dtype=bool), []
    while True:
        names, held = np.unique(label[open_], return_counts=True)
        if len(names) <= 1:
            return links, label
        pivot = int(np.flatnonzero(open_ & (label == names[np.argmin(held)]))[0])
        open_[pivot] = False
        for other in index.near(sets[pivot], num, den).tolist():
            if label[other] != label[pivot]:
                links.append((pivot, other))
                label[label == label[other]] = label[pivot]


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[int], list[np.ndarray]]]:
    """(key, nodes, sets) of each run of equal keys; a node that repeats comes once."""
    key, found = None, {}
    for batch in batches:
        for k, node, tokens in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            if k != key:
                if found:
                    yield key, list(found), list(found.values())
                key, found = k, {}
            found[node] = np.frombuffer(tokens, dtype=np.uint64)
    if found:
        yield key, list(found), list(found.values())


def _link_rows(num: int, den: int, keys: tuple[str, ...]):
    """Links of each run of equal keys; rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, sets in _blocks(batches, keys):
            links = verify(sets, num, den)[0] if len(sets) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def bitmap_words(n: np.ndarray) -> np.ndarray:
    """Words of 64 bits that the bitmap of a set of n has: a power of two, with two to four bits a shingle."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64))


def bitmap(values: np.ndarray) -> np.ndarray:
    """The parity of the shingles at each place; bitmaps of two sets differ in at most as many bits as the sets."""
    places = 64 * int(bitmap_words(np.array([len(values)]))[0])
    odd = np.bincount((values & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class _Bitmaps:
    """Bitmaps one after the other, cut to any number of words by folding."""

    def __init__(self, n: np.ndarray, flat: np.ndarray) -> None:
        self.n, words = n, bitmap_words(n)
        start = np.cumsum(words) - words
        self.by_words = {}
        for k in np.unique(words).tolist():
            at = np.flatnonzero(words == k)
            self.by_words[k] = (at, flat[start[at][:, None] + np.arange(k)])

    def folded(self, k: int, to: int) -> np.ndarray:
        bits = self.by_words[k][1]
        while bits.shape[1] > to:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        return bits


def may_link(hosts: _Bitmaps, host_part: np.ndarray, guests: _Bitmaps, guest_part: np.ndarray, num: int, den: int) -> np.ndarray:
    """Guests that can have a similarity of num / den or more to a host of another part; none that has one is missing."""
    found = np.zeros(len(guests.n), dtype=bool)
    for a, (host, _) in hosts.by_words.items():
        for b, (guest, _) in guests.by_words.items():
            k = min(a, b)
            mine, theirs, step = hosts.folded(a, k), guests.folded(b, k), max(1, STEP_WORDS // (len(host) * k))
            for low in range(0, len(guest), step):
                some = guest[low : low + step]
                apart = np.bitwise_count(theirs[low : low + step, None] ^ mine[None]).sum(axis=2, dtype=np.int64)
                x, y = guests.n[some][:, None], hosts.n[host][None]
                near = ((den + num) * (x + y - apart) >= 2 * num * (x + y)) & (den * np.minimum(x, y) >= num * np.maximum(x, y))
                found[some] |= (near & (guest_part[some][:, None] != host_part[host][None])).any(axis=1)
    return found


_WITHIN = "label bigint, block bigint, node bigint, part bigint, pivot boolean, single boolean, tokens binary"


def _within(num: int, den: int):
    """Each block's sets with their component in the block; one set of each is its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (label, block), nodes, sets in _blocks(batches, ("label", "block")):
            part = verify(sets, num, den)[1]
            names, first, held = np.unique(part, return_index=True, return_counts=True)
            at, n = np.searchsorted(names, part), len(nodes)
            pivot = np.zeros(n, dtype=bool)
            pivot[first] = True
            columns = [pa.array([label] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(nodes, pa.int64())]
            columns += [pa.array(np.array(nodes, dtype=np.int64)[first[at]]), pa.array(pivot), pa.array(held[at] == 1), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "block", "node", "part", "pivot", "single", "tokens"])

    return run


_PACK = "label bigint, block bigint, guest boolean, nodes binary, parts binary, sizes binary, bits binary"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of each block's sets, many in a row: of all as hosts, and of those that visit other blocks as guests."""
    names = [x.split()[0] for x in _PACK.split(", ")]

    def row(key: tuple[int, int, bool], sets: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        packed = [np.array([x[i] for x in sets], dtype=np.int64).tobytes() for i in range(3)] + [b"".join(x[3] for x in sets)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, *packed), (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4), strict=True)], names)

    at, open_ = None, {}
    for batch in batches:
        for label, block, node, part, visits, tokens in zip(*(batch.column(c).to_pylist() for c in ("label", "block", "node", "part", "visits", "tokens")), strict=True):
            if (label, block) != at:
                yield from (row(k, v) for k, (v, _) in open_.items())
                at, open_ = (label, block), {}
            bits = bitmap(np.frombuffer(tokens, dtype=np.uint64)).tobytes()
            for guest in (False, True)[: 1 + visits]:
                sets, size = open_.pop((label, block, guest), ([], 0))
                sets.append((node, part, len(tokens) // 8, bits))
                if size + len(bits) + 24 < PACK_BYTES:
                    open_[label, block, guest] = sets, size + len(bits) + 24
                else:
                    yield row((label, block, guest), sets)
    yield from (row(k, v) for k, (v, _) in open_.items())


def _visits(num: int, den: int):
    """(label, block, node) of guests that may have a partner in a block; a block's hosts come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hosts, index = None, [], None
        for batch in batches:
            for label, block, guest, *packed in zip(*(batch.column(c).to_pylist() for c in ("label", "block", "guest", "nodes", "parts", "sizes", "bits")), strict=True):
                if (label, block) != key:
                    key, hosts, index = (label, block), [], None
                nodes, parts, sizes = (np.frombuffer(x, dtype=np.int64) for x in packed[:3])
                bits = np.frombuffer(packed[3], dtype=np.uint64)
                if not guest:
                    hosts.append((parts, sizes, bits))
                    continue
                if not hosts:
                    continue
                if index is None:
                    host_part, *rest = (np.concatenate(x) for x in zip(*hosts, strict=True))
                    index = _Bitmaps(*rest)
                nodes = nodes[may_link(index, host_part, _Bitmaps(sizes, bits), parts, num, den)]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(nodes), pa.int64()), pa.array([block] * len(nodes), pa.int64()), pa.array(nodes)], ["label", "block", "node"])

    return run


def _across(num: int, den: int):
    """Links between the parts of a block, whose sets come first, and its guests from other blocks, which are read one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, parts, index = None, [], [], None
        for batch in batches:
            links = set()
            for label, block, guest, part, tokens in zip(*(batch.column(c).to_pylist() for c in ("label", "block", "guest", "part", "tokens")), strict=True):
                if (label, block) != key:
                    key, sets, parts, index = (label, block), [], [], None
                values = np.frombuffer(tokens, dtype=np.uint64)
                if not guest:
                    sets.append(values)
                    parts.append(part)
                    continue
                if not sets:  # no class of the group lies in this block
                    continue
                if index is None:
                    index, parts = _Index(sets), np.array(parts, dtype=np.int64)
                links |= {(part, other) for other in np.unique(parts[index.near(values, num, den)]).tolist()}
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _links_across(sets: DataFrame, blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Links of sets that visit with sets of other blocks and parts; sets(label, block, node, part, visits, tokens) are
    runs of equal blocks, blocks(label, there) has the blocks of each label."""
    packs = sets.mapInArrow(_packs, _PACK)
    near = F.filter("there", lambda x: (x != F.col("block")) & (F.abs(F.shiftright(x, 32) - F.shiftright("block", 32)) <= 1))
    guests = packs.where("guest").join(blocks, "label").withColumn("block", F.explode(near)).drop("there")
    met = packs.where("not guest").unionByName(guests).repartition("label", "block").sortWithinPartitions("label", "block", "guest")
    visits = checkpoint(met.mapInArrow(_visits(num, den), "label bigint, block bigint, node bigint"))
    guests = visits.join(sets.select("node", "part", "tokens"), "node").select("label", "block", F.lit(True).alias("guest"), "part", "tokens")
    hosts = sets.join(visits.select("label", "block").distinct(), ["label", "block"], "left_semi").select("label", "block", F.lit(False).alias("guest"), "part", "tokens")
    met = hosts.unionByName(guests).repartition("label", "block").sortWithinPartitions("label", "block", "guest")
    return checkpoint(met.mapInArrow(_across(num, den), "a bigint, b bigint").distinct())


def _large_groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what is linked in groups of several blocks; sets(label, block, node, tokens), and the high
    half of block is the step of sizes."""
    parts = sets.repartition("label", "block").sortWithinPartitions("label", "block")
    parts = checkpoint(parts.mapInArrow(_within(num, den), _WITHIN))
    blocks = parts.groupBy("label").agg(F.collect_set("block").alias("there"))
    links = parts.where("node <> part").select(F.col("part").alias("a"), F.col("node").alias("b"))
    across = _links_across(parts.withColumn("visits", F.col("pivot")), blocks, num, den)
    links = links.unionByName(across)

    # Pivots have met all others, and so have sets that are alone in their block's component. Of the rest, pairs in different components haven't.
    joined = contract(across, "a", "b").select(F.col("node").alias("part"), "component")
    rest = parts.where("not pivot").join(joined, "part", "left").withColumn("part", F.coalesce("component", "part"))
    open_ = rest.groupBy("label").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("label")
    if open_.isEmpty():
        return links
    rest = rest.join(open_, "label", "left_semi").select("label", "block", "node", "part", F.lit(True).alias("visits"), "tokens")
    rest = checkpoint(rest.repartition("label", "block").sortWithinPartitions("label", "block"))
    return links.unionByName(_links_across(rest, blocks, num, den))


def _classes_and_components(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows(id, th, node, n), classes(node, rep)): th is the hash of a row's text, node its set's 128 bits, and rep the
    least (id, th) of the set's component."""
    rule, both = _Rule(num, den), ["id", "th"]
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    profile = checkpoint(texts.mapInArrow(_profile(width, rule), "id bigint, th bigint, node binary, n bigint"))
    rows = profile.where("node is not null")
    classes = rows.where("n > 0").groupBy("node").agg(F.min(F.struct(*both)).alias("rep"), F.max("n").alias("n"))
    classes = checkpoint(classes.withColumn("k", F.xxhash64(F.monotonically_increasing_id())))

    entries = (classes.agg(F.sum("n")).first()[0] or 0) * 3 // 8
    least = max(HOT_LEAST, entries // HOT_SHARE)
    hot = profile.where("node is null").groupBy("th").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("th").toArrow()  # at most 2 * HOT_SHARE rows
    hot_token, hot_count = (hot[c].to_numpy() for c in ("th", "n"))
    order = np.argsort(hot_token.view(np.uint64))
    hot_token, hot_count = hot_token.view(np.uint64)[order], hot_count[order]
    buckets, name_words = _ceil(entries + 1, BUCKET_SHINGLES * 3 // 8), _name_words(classes)

    dealt = texts.mapInArrow(_prefixes(width, rule, buckets, hot_token, name_words), "bucket int, nodes binary, counts binary, tokens binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared(buckets, hot_token, hot_count, name_words), "node binary, token bigint, df int")
    per_class = shared.groupBy("node").agg(F.collect_list(F.struct("token", "df")).alias("t")).join(classes.withColumn("node", F.substring("node", 1, 8 * name_words)), "node")
    per_class = per_class.select(F.col("k").alias("node"), "n", F.col("t.token").alias("tokens"), F.col("t.df").alias("dfs"))
    signed = checkpoint(per_class.mapInArrow(_signature_rows(rule), "sig bigint, node bigint"))
    stars = signed.groupBy("sig").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last")
    groups = contract(signed.join(stars, "sig").select("node", "centre"), "node", "centre").withColumnRenamed("component", "label")

    wanted = groups.join(classes.select(F.col("k").alias("node"), "rep", "n"), "node").withColumn("step", F.floor(F.log("n") / math.log(rule.size_step())))
    weight = wanted.groupBy("label", "step").agg(F.sum("n").alias("own")).withColumn("large", F.sum("own").over(Window.partitionBy("label")) > BLOCK_SHINGLES)
    wanted = wanted.join(weight, ["label", "step"])
    block = F.shiftleft("step", 32) + F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / BLOCK_SHINGLES))
    wanted = checkpoint(wanted.select(F.col("rep.id").alias("wanted_id"), F.col("rep.th").alias("wanted_th"), "node", "label", "large", F.when(F.col("large"), block).otherwise(0).alias("block")))
    same = F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("th") == F.col("wanted_th"))
    asked = _bitmap(wanted.select(F.col("wanted_th").alias("shingle")), wanted.count())
    sets = texts.mapInArrow(_tokens(width, asked), "id bigint, th bigint, tokens binary").join(wanted.hint("shuffle_hash"), same)
    sets = sets.select("node", "label", "large", "block", "tokens")
    if several := not wanted.where("large").isEmpty():
        sets = checkpoint(sets)
    small = sets.where("not large").repartition("label").sortWithinPartitions("label")
    links = small.mapInArrow(_link_rows(num, den, ("label",)), "a bigint, b bigint")
    if several:
        links = links.unionByName(_large_groups(sets.where("large").drop("large"), num, den))

    repeated = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    own = rows.where("n > 0").join(repeated, "id", "left_semi").join(classes.select("node", "k"), "node").select("id", "k")
    by_id = own.join(own.groupBy("id").agg(F.min("k").alias("centre")), "id").select(F.col("k").alias("a"), F.col("centre").alias("b"))
    joined = contract(links.unionByName(by_id), "a", "b")
    joined = joined.join(classes.select(F.col("k").alias("node"), "rep"), "node")
    least_rep = joined.groupBy("component").agg(F.min("rep").alias("least"))
    joined = joined.join(least_rep, "component").select(F.col("node").alias("k"), "least")
    return rows, classes.join(joined, "k", "left").select("node", F.coalesce("least", "rep").alias("rep"))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs.

    Words are runs of anything but space and tab to carriage return, A to Z lower-cased. Two rows link when
    den * |intersection| >= num * |union| of their distinct width-word shingles; fewer words are one shingle; a null,
    empty or blank text has none and links with nothing. Ids are whole numbers. component_id is the smallest id
    reachable, null where a row without an id is. Rows of one id that have words count as linked with each other; rows
    without an id don't. Other columns are not read.
    """
    rows, classes = _classes_and_components(docs, id_col, text_col, width, num, den)
    found = rows.join(classes, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep.id")).otherwise(F.col("id")).alias("component_id"))
    return found


def _cell(text_hash: Column) -> Column:
    return F.shiftright(text_hash.bitwiseAND(F.lit(MARKS - 1)), 6)


def _place(text_hash: Column) -> Column:
    return text_hash.bitwiseAND(F.lit(63)).cast("int")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule: int) -> DataFrame:
    """docs with one document of each component of near copies: that with the smallest id, where a row without an id
    comes first, and of equal ids the text with the smallest hash.

    Rows of one id are one document, of which one row stays; so are rows without an id that have equal texts. Texts
    without words stay.
    """
    rule = {"width": 5, "num": 75, "den": 100} | rule
    rows, classes = _classes_and_components(docs, id_col, text_col, rule["width"], rule["num"], rule["den"])
    found = checkpoint(rows.join(classes, "node", "left").select("id", "th", (F.col("n") > 0).alias("has"), "rep"))
    gone = found.where(F.col("has") & ~(F.col("rep.id").eqNullSafe(F.col("id")) & (F.col("rep.th") == F.col("th")))).select("id", "th").distinct()
    text_hash = F.xxhash64(docs[text_col].cast("string"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _place(F.col("th")))
    marks = gone.groupBy(_cell(F.col("th")).alias("cell")).agg(F.bit_or(bit).alias("bits"))
    marked = (_cell(text_hash) == marks["cell"]) & (F.getbit(marks["bits"], _place(text_hash)) == 1)
    same = docs[id_col].cast("bigint").eqNullSafe(gone["id"]) & (text_hash == gone["th"])
    kept = docs.join(F.broadcast(marks), marked, "left_semi").join(gone.hint("shuffle_hash"), same, "left_anti")
    kept = docs.join(F.broadcast(marks), marked, "left_anti").union(kept)
    if found.groupBy("id").count().where("count > 1").isEmpty():
        return kept
    key = spare_name(docs, "key")
    own = F.coalesce(F.concat(F.lit("id "), F.col(id_col).cast("string")), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)))
    return kept.withColumn(key, own).dropDuplicates([key]).drop(key)
