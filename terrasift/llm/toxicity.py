"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are all words, and beginnings of words, of the examples; their document frequencies are counted over all
documents. Besides its IDF a term has a weight by its tie to the label (phi), which is never 0. Words that no example has
match nothing; they count for no neighbour and not in the length of a query.
The examples form an inverted index, cut in blocks of similar examples. A query reads the short lists whole. Of the terms
with the longest lists, every block knows the highest weight: with it, a block's highest cosine is bounded, and only
blocks that may hold one of the k nearest are read, those with the highest bounds first. Votes by squared cosine are
calibrated on examples that are scored without themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpoint, small_batches
from .labelled import labelled_sample, remainder
from .words import ALNUM, Words, distinct_by_row, mix, text_chunks

#: Labelled rows that are examples, neighbours that vote, and examples that the calibration is fitted on.
EXAMPLES, NEIGHBOURS, CALIBRATION = 4096, 9, 2048
#: Chi-square that a term reaches by chance, and the weight of terms without a tie to the label; it grows to 1 with the tie.
NOISE, LEAST_TIE = 10.0, 0.005
#: Terms whose lists are kept by block, examples of a block, and blocks that a query reads first.
HEAD, BLOCK, FIRST = 1024, 64, 4
#: Queries of one step, which read a block together, and terms that they have together, give or take those of one text.
STEP, HELD = 256, 1 << 20
#: What rounding may make a cosine wrong by.
SLACK = 1e-12
#: Beginnings of longer words, in bytes, that are terms as well: inflected words share them.
PREFIXES = (4, 5, 6)
#: Votes of weight 1 that the base rate counts as, and score from which a text counts as toxic.
PRIOR, THRESHOLD = 0.5, 0.3


def _hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the words and of their beginnings; a beginning differs from the word that is written like it."""
    row, size = words.row_of_word(), words.end - words.start
    values, rows = [words.hashes()], [row]
    for n in PREFIXES:
        long = np.flatnonzero(size > n)
        values.append(mix(words.hashes_to(words.start[long], words.start[long] + n)))
        rows.append(row[long])
    return np.concatenate(values), np.concatenate(rows)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a term, batch by batch."""
    for batch in batches:
        y = batch.column("y").to_numpy()
        terms, labels = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for low, high, data, offsets in text_chunks(batch.column("text")):
            value, first = distinct_by_row(*_hashes(Words(data, offsets, ALNUM, lower=True)), high - low)
            terms.append(value)
            labels.append(np.repeat(y[low:high], np.diff(first)))
        term, place = np.unique(np.concatenate(terms), return_inverse=True)
        label = np.concatenate(labels)
        ones = np.bincount(place, weights=label, minlength=len(term)).astype(np.int64)
        every = np.bincount(place, minlength=len(term))
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(ones), pa.array(every)], ["term", "ones", "every"])


def _by_high_bits(terms: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """(shift, first): the sorted terms whose bits from shift on are i are terms[first[i]:first[i + 1]], one or none as a rule."""
    bits = max(20, len(terms).bit_length())
    shift = np.uint64(64 - bits)
    count = np.bincount((terms >> shift).astype(np.int64), minlength=1 << bits)
    return shift, np.concatenate(([0], np.cumsum(count))).astype(np.int32)


def _look_up(hashes: np.ndarray, terms: np.ndarray, shift: np.uint64, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, term numbers) of the hashes that are terms, in no order."""
    high = (hashes >> shift).astype(np.int64)
    at, end = first[high], first[high + 1]
    hit = np.flatnonzero(at < end)
    at, end = at[hit], end[hit]
    places, numbers = [], []
    while len(hit):
        same = terms[at] == hashes[hit]
        places.append(hit[same])
        numbers.append(at[same])
        more = ~same & (at + 1 < end)
        hit, at, end = hit[more], at[more] + 1, end[more]
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *numbers])


def _vectors(column: pa.Array, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, term numbers, counts) of the texts that have any of the sorted terms."""
    shift, first = _by_high_bits(terms)
    for low, _, data, offsets in text_chunks(column):
        words = Words(data, offsets, ALNUM, lower=True)
        if not len(words.start) or not len(terms):
            continue
        hashes, rows = _hashes(words)
        hit, at = _look_up(hashes, terms, shift, first)
        if not len(hit):
            continue
        code, count = np.unique(rows[hit] * len(terms) + at, return_counts=True)
        row, term = np.divmod(code, len(terms))
        cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(row)), strict=True):
            yield low + int(row[a]), term[a:b], count[a:b]


def _weigh(term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weight = (1 + np.log(count)) * idf[term]
    return weight / np.sqrt((weight * weight).sum())


class Examples:
    """The labelled examples that have terms, by example and, once searched, by term.

    Counts are kept instead of weights, so that cosines are computed in full precision.
    """

    def __init__(self, terms: np.ndarray, idf: np.ndarray, rows: list[tuple[int, int, np.ndarray, np.ndarray]], base: float) -> None:
        self.terms, self.idf, self.base, self.owner, self.calibration, self.shared, self.loaded = terms, idf, base, None, None, None, False
        rows = sorted(rows, key=lambda r: r[0])
        self.ids, self.y = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows]))).astype(np.int64)
        self.term = np.concatenate([np.zeros(0, np.int32), *(np.asarray(r[2], np.int32) for r in rows)])
        self.count = np.concatenate([np.zeros(0, np.int32), *(np.asarray(r[3], np.int32) for r in rows)])
        norms = [np.sqrt((w * w).sum()) for r in rows for w in [(1 + np.log(r[3])) * idf[r[2]]]]
        self.inverse = 1 / np.array(norms, dtype=np.float64)

    def __getstate__(self) -> dict:
        """Without the lists by term; terms as differences, and bytes of one place next to each other, as they then shrink most."""
        packed = [zlib.compress(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in (np.diff(self.term, prepend=0), self.count)]
        return {k: v for k, v in self.__dict__.items() if k in ("terms", "idf", "base", "ids", "y", "first", "inverse")} | {"packed": packed}

    def __setstate__(self, state: dict) -> None:
        term, count = (np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view(np.int32).ravel() for x in state.pop("packed"))
        self.__dict__ |= state | {"term": np.cumsum(term, dtype=np.int32), "count": count, "owner": None, "calibration": None, "shared": None, "loaded": True}

    def _weights(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of an example."""
        own = slice(self.first[i], self.first[i + 1])
        return self.term[own], self.logs[self.count[own]] * self.idf[self.term[own]] * self.inverse[i]

    def _invert(self) -> None:
        """The lists by term, and the blocks; examples whose heaviest head term is the same become neighbours in them.

        Examples are gone through one by one, so that besides the lists nothing of their size is held.
        """
        n = len(self.ids)
        self.logs = 1 + np.log(np.maximum(np.arange(self.count.max(initial=0) + 1), 1))
        head = np.argsort(-np.bincount(self.term, minlength=len(self.terms)), kind="stable")[:HEAD]
        self.head = np.full(len(self.terms), -1, dtype=np.int32)
        self.head[head] = np.arange(len(head))
        heaviest = np.zeros(n, dtype=np.int64)
        for i in range(n):
            term, weight = self._weights(i)
            row = self.head[term]
            if (row >= 0).any():
                most = weight[row >= 0].max()
                heaviest[i] = row[(row >= 0) & (weight == most)].min()
        self.order = np.lexsort((self.ids, heaviest))
        self.blocks = -(-n // BLOCK)
        self.dense = np.zeros((self.blocks, len(head), BLOCK))
        rest = self.head[self.term] < 0
        self.at = np.concatenate(([0], np.cumsum(np.bincount(self.term[rest], minlength=len(self.terms)))))
        free, self.owner, self.part = self.at[:-1].copy(), np.zeros(self.at[-1], dtype=np.int32), np.zeros(self.at[-1])
        del rest
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        for i in range(n):
            term, weight = self._weights(i)
            row = self.head[term]
            block, column = divmod(int(place[i]), BLOCK)
            self.dense[block, row[row >= 0], column] = weight[row >= 0]
            others = term[row < 0]  # each of them once
            self.owner[free[others]], self.part[free[others]] = place[i], weight[row < 0]
            free[others] += 1
        self.most = np.ascontiguousarray(self.dense.max(axis=2).T) if n else np.zeros((len(head), 0))
        if self.loaded:
            self.term = self.count = np.zeros(0, dtype=np.int32)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, own: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the k nearest of each query (terms, weights), with a cosine above 0, best first, ties to
        the smaller id. Examples with the id in own are no neighbours of that query."""
        if self.owner is None:
            self._invert()
        width = self.blocks * BLOCK
        sums, asked = np.zeros((len(queries), width)), np.zeros((len(queries), self.most.shape[0]))
        for i, (term, weight) in enumerate(queries):
            row = self.head[term]
            asked[i, row[row >= 0]] = weight[row >= 0]
            term, weight = term[row < 0], weight[row < 0]
            low, size = self.at[term], self.at[term + 1] - self.at[term]
            places = np.repeat(low - (np.cumsum(size) - size), size)
            places += np.arange(len(places))  # the lists, one behind the other
            part = self.part[places]
            part *= np.repeat(weight, size)
            sums[i] = np.bincount(self.owner[places], weights=part, minlength=width)
        by_block = sums.reshape(len(queries), self.blocks, BLOCK)
        bound = asked @ self.most + by_block.max(axis=2) if self.blocks else np.zeros((len(queries), 0))
        read = np.zeros(bound.shape, dtype=bool)

        def complete(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                who = np.flatnonzero(wanted[:, b])
                by_block[who, b] += asked[who] @ self.dense[b]
            read[wanted] = True

        first, kth = max(FIRST, -(-2 * k // BLOCK)), np.full(len(queries), -np.inf)
        best = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(best, np.argsort(-bound, axis=1)[:, :first], True, axis=1)
        complete(best)
        for i in range(len(queries)):
            known = by_block[i, read[i]].ravel()
            if len(known) > k + 1:
                kth[i] = np.partition(known, len(known) - k - 1)[len(known) - k - 1]
        complete(~read & (bound >= kth[:, None] - SLACK) & (bound > 0))
        out = []
        for i in range(len(queries)):
            known = np.where(read[i][:, None], by_block[i], -np.inf).ravel()[: len(self.ids)]
            least = np.partition(known, len(known) - k - 1)[len(known) - k - 1] if len(known) > k + 1 else -np.inf
            at = np.flatnonzero((known >= least - SLACK) & (known > 0))
            who, cosine = self.order[at], np.round(known[at], 12)
            if own is not None and own[i] is not None:
                other = self.ids[who] != own[i]
                who, cosine = who[other], cosine[other]
            top = np.lexsort((self.ids[who], -cosine))[:k]
            out.append((who[top], cosine[top]))
        return out

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: list[int | None] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(vote, ids of the nearest, cosines) of vectors (terms, counts): votes weighted by squared cosine, drawn to the
        base rate."""
        out = []
        for who, cosine in self.nearest([(term, _weigh(term, count, self.idf)) for term, count in vectors], NEIGHBOURS, own):
            vote = cosine * cosine
            out.append((float(((vote * self.y[who]).sum() + PRIOR * self.base) / (vote.sum() + PRIOR)), self.ids[who], cosine))
        return out

    def search(self, column: pa.Array, own: list[int | None] | None = None) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        """(row, vote, ids, cosines) of the texts that have any term."""
        rows, vectors, held = [], [], 0
        for row, term, count in _vectors(column, self.terms):
            rows.append(row)
            vectors.append((term, count))
            held += len(term)
            if len(rows) == STEP or held >= HELD:
                yield from ((r, *v) for r, v in zip(rows, self.votes(vectors, own and [own[r] for r in rows]), strict=True))
                rows, vectors, held = [], [], 0
        yield from ((r, *v) for r, v in zip(rows, self.votes(vectors, own and [own[r] for r in rows]), strict=True))

    def scores(self, votes: np.ndarray) -> np.ndarray:
        """Calibrated scores of votes; they keep their order."""
        if self.calibration is None:
            return votes
        slope, shift = self.calibration
        return 1 / (1 + np.exp(-np.clip(slope * _logit(votes) + shift, -30, 30)))


def _logit(votes: np.ndarray) -> np.ndarray:
    votes = np.clip(votes, 1e-4, 1 - 1e-4)
    return np.log(votes / (1 - votes))


def calibrate(votes: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """Slope and shift of the logistic curve of labels over the votes' logits, by Newton's method on smoothed labels
    (Platt); none where a label is missing or votes and labels don't rise together."""
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    if not ones or not zeros:
        return None
    x, goal = np.stack([_logit(votes), np.ones(len(votes))]), np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - goal) + 1e-3 * (w - [1.0, 0.0]))
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else None


def fit(docs: DataFrame, labels: DataFrame, usable, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Examples:
    """The index of at most EXAMPLES labelled documents for which usable, a condition on labels, holds; equal texts are
    one example, with the smallest id and the largest label.

    Terms are all words and beginnings in the examples, weighted by their tie to the label. Without labels, or with one label
    only, there are no terms, and every text gets the base rate (0 without labels).
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, usable, EXAMPLES, id_col, text_col).groupBy("text").agg(F.min("id").alias("id"), F.max("y").alias("y"))
    sample = checkpoint(sample)
    size, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    terms, tie = np.zeros(0, dtype=np.uint64), np.zeros(0)
    if 0 < ones < size:
        n, p = float(size), float(ones)
        counts = sample.select("text", "y").mapInArrow(_term_counts, "term bigint, ones bigint, every bigint").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("every").alias("every")).toArrow()
        terms = counts["term"].to_numpy().view(np.uint64)
        order = np.argsort(terms)
        terms, of, every = terms[order], *(counts[c].to_numpy()[order].astype(np.float64) for c in ("ones", "every"))
        chi2 = (of * n - every * p) ** 2 * n / np.maximum(every * (n - every) * (p * (n - p)), 1.0)
        tie = np.maximum(LEAST_TIE, np.sqrt(np.maximum(chi2 - NOISE, 0.0) / n))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, dtype=np.int64)
        for batch in batches:
            total[-1] += len(batch)
            for _, term, _ in _vectors(batch.column(0), terms):
                total[term] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    df = np.zeros(len(terms) + 1)
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(frequencies, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    df[found["k"].to_numpy()] = found["n"].to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * tie

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {row: (term, count) for row, term, count in _vectors(batch.column("text"), terms)}
            pick = pa.array(list(found), pa.int64())
            pairs = [pa.array([x[j].astype(np.int32).tobytes() for x in found.values()], pa.binary()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("y").take(pick), *pairs], ["id", "y", "term", "count"])

    rows = sample.select(F.col("id").cast("long").alias("id"), "text", "y").mapInArrow(vectors, "id bigint, y int, term binary, count binary").toArrow()
    made = [(i, y, np.frombuffer(t, np.int32), np.frombuffer(c, np.int32)) for i, y, t, c in zip(*(rows[c].to_pylist() for c in ("id", "y", "term", "count")), strict=True)]
    model = Examples(terms, idf, made, ones / size if size else 0.0)
    model.shared = docs.sparkSession.sparkContext.broadcast(model)
    if len(terms):
        index = model.shared

        def without_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(vote, row) for row, vote, _, _ in index.value.search(batch.column("text"), batch.column("id").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.float64()), batch.column("y").take(pa.array([r for _, r in found], pa.int64()))], ["vote", "y"])

        some = sample.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION)
        votes = some.select(F.col("id").cast("long").alias("id"), "text", "y").repartition(16).mapInArrow(without_itself, "vote double, y int").toArrow()
        model.calibration = calibrate(*(votes[c].to_numpy() for c in ("vote", "y")))
    return model


def score_texts(docs: DataFrame, examples: Examples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, neighbours, cosines) for every row of docs; a text without terms (null, empty) gets the calibrated
    base rate of the examples, and no neighbours. Ids of examples are whole numbers. Other columns are not read; rows may
    repeat."""
    index, calibration = examples.shared, examples.calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        own.calibration = calibration
        for batch in batches:
            vote, ids, cosines = np.full(len(batch), own.base), [[]] * len(batch), [[]] * len(batch)
            for row, found, who, cosine in own.search(batch.column("text")):
                vote[row], ids[row], cosines[row] = found, who.tolist(), cosine.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.scores(vote)), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], ["id", "score", "neighbours", "cosines"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, score double, neighbours array<bigint>, cosines array<double>").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, examples: Examples, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below THRESHOLD; so does a null or empty text as long as the
    base rate does. Rows that repeat are judged alike; an empty table stays one."""
    index, calibration = examples.shared, examples.calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        own.calibration = calibration
        for batch in batches:
            vote = np.full(len(batch), own.base)
            for row, found, _, _ in own.search(batch.column(text_col)):
                vote[row] = found
            yield batch.filter(pa.array(own.scores(vote) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def learnable(id_col: str = "doc_id"):
    """Rows whose labels may be learned from."""
    return F.coalesce(remainder(id_col, 4) != 2, F.lit(True))
