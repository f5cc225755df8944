"""Each operator against brute force on small tables with nulls, empty and long texts, repeats, and clashing columns."""

import collections
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasift.llm import components, jaccard, licenses, quality, revisits, secrets, sharding, topk, toxicity
from terrasift.llm.components import connected_components
from terrasift.llm.decontamination import drop_contaminated, find_contamination
from terrasift.llm.mixing import mix, mixed_documents
from terrasift.llm.words import ALNUM, NOT_SPACE, Words, text_chunks, window_hashes

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, source string, size long, n_words int, key string, label string"


def corpus(seed=0, n=60):
    """Documents with copies, near copies, shared passages, nulls, blanks, a long text, and columns with busy names."""
    r = random.Random(seed)
    words = lambda k: [r.choice(WORDS) for _ in range(k)]
    texts = [" ".join(words(r.choice([3, 8, 30, 60]))) for _ in range(n)]
    base = words(120)
    for k in range(12):
        copy = base[:]
        copy[r.randrange(120)] = f"edit{k}"
        texts.append("\n".join([" ".join(copy[:60]), " ".join(copy[60:])]))
    texts += [" ".join(base).upper(), " ".join(base), " ".join(base), "one", "ONE", "one two three four", None, "", " \t\n", " ".join(words(9000)), "é " * 40, "naïve Café x " * 6]
    passage = " ".join(words(20))
    texts += [" ".join(words(40)) + " " + passage for _ in range(5)]
    rows = [(i, t, None if i % 9 == 0 else f"s{i % 4}", 7, 3, "k", "l") for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, "no id here at all", "s1", None, None, None, None)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def test_words_match_regular_expressions():
    texts = [r[1] for r in corpus()] + ["a", "", "x--y", "ÀÉ_z9", "tail "]
    import pyarrow as pa

    for kinds, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        for low, high, data, offsets in text_chunks(pa.array(texts)):
            words = Words(data, offsets, kinds, lower=True)
            got = [[words.word(j).decode() for j in range(words.first[i], words.first[i + 1])] for i in range(high - low)]
            assert got == [re.findall(pattern, lower(t)) for t in texts[low:high]]
            hashes = words.hashes()
            by_word = collections.defaultdict(set)
            for j, h in enumerate(hashes.tolist()):
                by_word[words.word(j)].add(h)
            assert all(len(v) == 1 for v in by_word.values()) and len({*map(min, by_word.values())}) == len(by_word)
    assert len(window_hashes(np.zeros(3, np.uint64), 5)) == 0


def components_by_force(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [0, 3, 50_000])
@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(30)] + [(50, 51)], [(5, 5)], []])
def test_components(spark, monkeypatch, pairs, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == components_by_force(pairs, {x for p in pairs for x in p})


def jaccard_by_force(rows):
    sets = {}
    for k, r in enumerate(rows):
        w = spaced(r[1])
        sets[k] = set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())
    pairs = [(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    ids = [r[0] if r[0] is not None else -1 for r in rows]
    comp = components_by_force([(ids[a], ids[b]) for a, b in pairs], set(ids))
    return sorted((i, len(sets[k]), comp[i]) for k, i in enumerate(ids))


@pytest.mark.parametrize("frequent, block", [(64, 1_500_000), (2, 1_500_000), (3, 150), (64, 60)])
def test_jaccard(spark, monkeypatch, frequent, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard.signatures, "__defaults__", (frequent,))
    rows = corpus(1)
    got = jaccard.near_duplicate_components(frame(spark, rows)).collect()
    mark = lambda x: -1 if x is None else x
    assert sorted((mark(r.doc_id), r.n_shingles, mark(r.component_id)) for r in got) == jaccard_by_force(rows)


def test_signatures_meet_for_every_similar_pair():
    """Any two sets at the threshold share a signature, whatever the frequencies."""
    rule, r = jaccard._Rule(75, 100), np.random.Generator(np.random.PCG64(3))
    for n in (3, 4, 7, 20, 33, 64, 150, 400):
        for _ in range(30):
            pool = r.integers(1, 2**63, 3 * n, dtype=np.uint64)
            x = np.sort(pool[:n])
            gone = r.integers(0, n // 4 + 1)
            y = np.sort(np.concatenate((r.permutation(x)[gone:], pool[n : n + (n - gone) // 8])))
            common = len(np.intersect1d(x, y))
            if 100 * common < 75 * (len(x) + len(y) - common):
                continue
            px, py = x[: rule.prefix(len(x))], y[: rule.prefix(len(y))]
            df = {int(t): int(f) for t, f in zip(pool, r.integers(2, 130, len(pool)), strict=True)}
            shared = set(px.tolist()) & set(py.tolist())
            keep = lambda p: np.array([t for t in p.tolist() if t in shared or df[t] % 2], dtype=np.uint64)  # noqa: B023, E731
            a, b = (jaccard.signatures(k, np.array([df[int(t)] for t in k]), len(s), rule) for k, s in ((keep(px), x), (keep(py), y)))
            assert len(np.intersect1d(a, b)), (len(x), len(y), common)


def chained(n=60):
    """Texts of 30 words that all lie in one group, as each shares a line with the next, and none of which are near copies;
    and two that are, one short and one in the size of the others."""
    r = random.Random(9)
    line = lambda: [f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(14)]
    lines = [line() for _ in range(n + 1)]
    texts = [" ".join([*lines[k], f"own{k}", f"mine{k}", *lines[k + 1]]) for k in range(n)]
    texts += [texts[3] + " end", texts[50].replace("own50", "own51")]
    return [(k, t, "s", 1, 1, "a", "b") for k, t in enumerate(texts)]


def test_sets_of_a_large_group_visit_few_blocks(spark, monkeypatch):
    """Shingles go where a partner may be, and not to every other block, so that they don't grow with the square of a group."""

    def counting(num, den):
        def run(batches):
            for batch in batches:
                some = batch.filter(batch.column("guest"))
                yield pa.RecordBatch.from_arrays([some.column("part"), some.column("block").cast(pa.int64())], ["a", "b"])

        return run

    kept, checkpoint = [], jaccard.checkpoint
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 60)
    rows = chained()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicate_components(frame(spark, rows)).collect())
    assert got == jaccard_by_force(rows)
    monkeypatch.setattr(jaccard, "_across", counting)
    monkeypatch.setattr(jaccard, "checkpoint", lambda x: (kept.append(y) if (y := checkpoint(x)).columns == ["a", "b"] else None, y)[1])
    jaccard.near_duplicate_components(frame(spark, rows)).collect()
    assert kept and sum(x.count() for x in kept) <= 8  # 798 where each visits every block


def test_bitmaps_bound_similarity():
    """A set that has a partner at the threshold is never left out, whatever their sizes; most others are."""
    r = np.random.Generator(np.random.PCG64(4))
    for n in (1, 5, 31, 33, 64, 65, 200, 700):
        sets = [np.sort(r.integers(1, 2**63, n, dtype=np.uint64))]
        for _ in range(40):
            gone, more = r.integers(0, n // 3 + 1, 2)
            sets.append(np.unique(np.concatenate((r.permutation(sets[0])[gone:], r.integers(1, 2**63, more, dtype=np.uint64)))))
        sets += [np.sort(r.integers(1, 2**63, n + n // 4, dtype=np.uint64)) for _ in range(40)]
        flat = lambda x: jaccard._Bitmaps(np.array([len(s) for s in x]), np.concatenate([jaccard.bitmap(s) for s in x]))
        found = jaccard.may_link(flat(sets[:1]), np.array([-1]), flat(sets), np.arange(len(sets)), 75, 100)
        common = np.array([len(np.intersect1d(sets[0], s)) for s in sets])
        near = 100 * common >= 75 * (np.array([len(s) for s in sets]) + len(sets[0]) - common)
        assert found[near].all() and near[0] and (n < 31 or not found[41:].any())
        assert not jaccard.may_link(flat(sets[:1]), np.array([7]), flat(sets), np.full(len(sets), 7), 75, 100).any()


def test_classes_that_64_bits_do_not_tell_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_name_words", lambda classes: 2)
    rows = corpus(1)
    mark = lambda x: -1 if x is None else x
    assert sorted((mark(r.doc_id), r.n_shingles, mark(r.component_id)) for r in jaccard.near_duplicate_components(frame(spark, rows)).collect()) == jaccard_by_force(rows)


def test_rows_that_stay_are_not_shuffled(spark):
    """Only rows whose hash is marked meet those that go in a shuffle; marks may be too many, never too few."""
    kept = jaccard.drop_near_duplicates(frame(spark, corpus(1)))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "LeftSemi" in plan


def test_drop_near_duplicates(spark):
    rows = corpus(1)
    kept = jaccard.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    force = jaccard_by_force(rows)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for i, _, c in force if i >= 0})
    assert jaccard.drop_near_duplicates(frame(spark, [])).count() == 0


def test_mixing(spark):
    rows = corpus(2)
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len(spaced(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in free}
        free -= full or free
        left -= sum(target[s] for s in full)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and len(r.positions) == (r.copies + (r.part > 0) if r["size"] else 0)
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(1, 0.005 * target[s]), s
    for k, s in enumerate(names):  # the demand up to a position is what has been taken before, and half of what stands there
        takes = sorted((p, r.part if r.part and j == len(r.positions) - 1 else r["size"]) for r in got if r.source == s for j, p in enumerate(r.positions))
        first, last = (1.5, 0.5) if k % 2 == 0 else (0.5, 1.5)
        every, done = sum(n for _, n in takes), 0
        for p, n in takes:
            assert abs(first * p + (last - first) * p * p / 2 - (done + n / 2) / every) < 1e-9
            done += n
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in mix(frame(spark, rows, 5)).collect()]
    mixed = mixed_documents(frame(spark, rows))
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({k: v for k, v in sum((collections.Counter({r.doc_id: r.copies + (2 * r.part >= max(r["size"], 1))}) for r in got), collections.Counter()).items() if v})
    assert mixed.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert mix(frame(spark, [])).count() == 0 and mixed_documents(frame(spark, [])).count() == 0


def test_mixing_follows_the_schedule(spark):
    """A source whose weight falls stands earlier than one whose weight rises."""
    rows = [(i, "a b c d", f"s{i % 2}", 0, 0, "", "") for i in range(400)]
    mean = {r.source: r.p for r in mix(frame(spark, rows)).where("copies > 0").groupBy("source").agg(F.avg(F.expr("positions[0]")).alias("p")).collect()}
    assert mean["s0"] < 0.47 and mean["s1"] > 0.45


def test_revisits(spark):
    rows, r = [], random.Random(5)
    for i in range(300):
        url = r.choice(["http://a.example/x", "https://www.a.example/x/#f", "http://b.example/?utm_x=1&q=2", None])
        kind = r.choice(["response", "revisit"])
        headers = None if r.random() < 0.1 else {k: v for k, v in (("etag", r.choice(['"1"', 'W/"1"', '"2"', None])), ("last-modified", r.choice(["m1", "m2", None])), ("date", f"d{i}"), ("content-type", "t")) if v}
        rows.append((i, kind, url, None if r.random() < 0.05 else 1_700_000_000 + r.randrange(40) * 500, headers, f"g{i}", i))
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, t long, headers map<string,string>, digest string, bytes long").withColumn("ts", F.timestamp_seconds("t")).withColumn("slot", F.lit("busy"))
    got = {x.record_id: x for x in revisits.resolve_revisits(df).collect()}
    canon = lambda u: {"http://a.example/x": "a", "https://www.a.example/x/#f": "a", "http://b.example/?utm_x=1&q=2": "b"}.get(u)
    assert set(got) == {x[0] for x in rows if x[1] == "revisit"}
    for i, _, url, t, headers, _, _ in (x for x in rows if x[1] == "revisit"):
        before = [x for x in rows if x[1] == "response" and canon(url) and canon(x[2]) == canon(url) and t and x[3] and x[3] < t]
        best = max(before, key=lambda x: (x[3], x[0]), default=None)
        g, h, s = got[i], headers or {}, (best[4] or {}) if best else {}
        strip = lambda x: x.removeprefix("W/")
        if not best:
            check = "no response"
        elif "etag" in h and "etag" in s:
            check = "etag" if strip(h["etag"]) == strip(s["etag"]) else "mismatch"
        elif "last-modified" in h and "last-modified" in s:
            check = "last-modified" if h["last-modified"] == s["last-modified"] else "mismatch"
        else:
            check = "unchecked"
        assert (g.response_id, g.check) == (best and best[0], check)
        if g.resolved:
            assert g.headers == s | {k: v for k, v in h.items() if k in revisits.PERMITTED} and g.digest == best[5]
        else:
            assert g.headers is None and g.digest is None
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def test_captures_of_odd_pages(spark):
    """Nulls, repeated rows and clashing columns: two records a page, and a revisit each in the result."""
    rows = [(1, "http://a.b/x", "<p>", "k"), (2, None, "<p>", "k"), (3, "http://a.b/y", None, "k"), (None, "http://a.b/z", "", "k"), (1, "http://a.b/x", "<p>", "k"), (4, "", "x" * 100_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    records = revisits.captures(pages).collect()
    assert collections.Counter(r.kind for r in records) == {"response": 6, "revisit": 6}
    of = {(r.kind, r.record_id): r for r in records}
    assert of["response", 6].digest is None and of["response", 6].bytes is None and "etag" not in of["response", 6].headers
    assert of["response", 4].url is None and of["response", 8].bytes == 100_000 and of["revisit", 3].url.endswith("#again")
    found = revisits.resolve_revisits(revisits.captures(pages)).collect()
    assert len(found) == 6 and all(r.check == "no response" for r in found if r.url is None)
    assert revisits.captures(pages.limit(0)).count() == 0


STAGE_ROWS = [(None, "no id and some words in it here", "s"), (1, None, "s"), (2, "", None), (3, " \t", None), (4, "plain words that stand alone in this text", "s"), (4, "plain words that stand alone in this text", "s"), (5, "long " * 30_000, "t"), (6, "plain words that stand alone in this text", "t")]


def test_stages_of_the_pipeline_on_odd_rows(spark, tmp_path):
    """Each stage by itself on nulls, blanks, a long text, repeats and clashing columns, and on an empty table."""
    import corpus_pipeline

    docs = spark.createDataFrame([(*r, 1, "c", 2.0) for r in STAGE_ROWS], "doc_id long, text string, source string, size int, shard string, score double")
    spark.createDataFrame([(1, "of the windows none is in the documents at all here"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    count = lambda df: collections.Counter((r.doc_id, (r.text or "")[:40]) for r in df.collect())
    every = count(docs)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name == "sharding":
            assert got.count() == len(STAGE_ROWS)
            continue
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        kept = count(got)
        if name in ("toxicity", "benchmark decontamination"):
            assert kept == every
        elif name == "n-gram Jaccard join":
            assert kept == collections.Counter({k: 1 for k in every if k[0] != 6})
        else:
            assert set(kept) <= set(every) and {k for k in every if k[0] in (4, 5)} <= set(kept)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_captures_of_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert revisits.resolve_revisits(revisits.captures(pages)).count() == pages.count()


def leaks_by_force(rows, items, width=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((str(r[0]), len(w), sorted(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("bits", [1 << 28, 1 << 10])
def test_decontamination(spark, monkeypatch, bits):
    """Also with a bitmap too small for its shingles, which lets most through to the join."""
    from terrasift.llm import decontamination

    monkeypatch.setattr(decontamination, "MOST_BITS", bits)
    rows = corpus(3)
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 12]
    r = random.Random(1)
    items = [(str(k), " ".join(r.choice(texts).split()[k % 5 : k % 5 + 5 + 3 * k])) for k in range(12)] + [("short", "one"), ("short", "one, TWO"), ("none", "..."), ("null", None), ("", "w1 w2")]
    table = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))
    got = find_contamination(frame(spark, rows), table).collect()
    spread = lambda x: [p for a, b in zip(x.starts, x.ends, strict=True) for p in range(a, b)]
    force = leaks_by_force(rows, [(k, t) for k, t in items])
    assert sorted((str(x.doc_id), x.n_words, spread(x), list(x["items"])) for x in got) == force
    kept = drop_contaminated(frame(spark, rows), table)
    assert kept.columns == frame(spark, rows).columns and sorted(str(x.doc_id) for x in kept.collect()) == sorted(d for d, _, hit, _ in force if not hit)
    assert find_contamination(frame(spark, rows), table.limit(0)).where(F.size("starts") > 0).count() == 0
    assert find_contamination(frame(spark, []), table).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.Generator(np.random.PCG64(2))
    rows = [(i, r.integers(-3, 4, 6).astype(float).tolist()) for i in range(230)]
    rows += [(500, rows[0][1]), (300, None), (301, [1.0, None] * 3), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (None, [1.0] * 6), (600, [1.0, 2.0]), (610, [3.0, 4.0]), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = topk.top_k(topk.scaled_vectors(df, scale=1), F.col("vec_id") % 10 == 0, 5).collect()
    usable = {i: np.array(v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    force = []
    for q in (i for i in usable if i % 10 == 0):
        scores = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:5]
        force += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(force)
    assert topk.top_k(topk.scaled_vectors(df.limit(0)), F.col("vec_id") % 10 == 0).count() == 0


def test_reading_stops_before_the_lists_end():
    """Candidates along one direction leave few that can qualify after the first step."""
    values = np.outer(np.arange(400), np.ones(8, dtype=np.int64))
    query, ids, scores = topk.block_top_k(np.array([-1]), np.ones((1, 8), dtype=np.int64), np.arange(400), values, 3)
    assert ids.tolist() == [399, 398, 397] and scores.tolist() == [3192, 3184, 3176]


def test_licenses(spark):
    text = "some text\nReleased under the MIT License.\nmore"
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "a/LICENSE"),
        (2, "no words", "a/b/x.txt"),
        (3, text, "a/b/y.txt"),
        (4, "This work is licensed under the GNU General Public License, version 3.", "/a/b/COPYING.txt"),
        (5, "plain", "a/b/c/z.txt"),
        (6, None, "q/z.txt"),
        (7, "plain", None),
        (8, "Licensed under CC BY-NC 4.0. " + "word " * 5000, "q/NOTICE"),
        (9, "", ""),
        (3, text, "a/b/y.txt"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("path", F.lit("busy"))
    got = {r.doc_id: (r.licence, r.origin) for r in licenses.scan_licenses(df, F.col("at")).collect()}
    assert got == {1: ("Apache-2.0", "header"), 2: ("GPL-3.0", "inherited"), 3: ("MIT", "header"), 4: ("GPL-3.0", "header"), 5: ("GPL-3.0", "inherited"), 6: (None, "none"), 7: (None, "none"), 8: (None, "none"), 9: (None, "none")}
    assert licenses.scan_licenses(df, F.col("at")).count() == len(rows) and licenses.scan_licenses(df.limit(0), F.col("at")).count() == 0


COMMON = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "MPL-1.1": "MPL-1.1", "CC0-1.0": "CC0-1.0", "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0"}
GRANT = "/*\n * Permission is\n * hereby granted, free of charge, to any person obtaining a copy of this\n * software and associated documentation files, to deal in the Software\n * without restriction.\n */\n\nint main;"
NOTICE = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n\nimport os"


@pytest.mark.parametrize("others", [False, True])
def test_licenses_of_real_texts(spark, others):
    """Whole licence texts, a wrapped grant, a wrapped notice and a tag, with and without other documents."""
    folder = Path("/usr/share/common-licenses")
    texts = {k: (folder / k).read_text(errors="replace") for k in COMMON if (folder / k).exists()}
    rows = [(k, t, f"{k}/LICENSE") for k, t in texts.items()] + [("grant", GRANT, "grant/a.c"), ("notice", NOTICE, "notice/a.py"), ("tag", "// SPDX-License-Identifier: MPL-2.0\nint x;", "tag/a.c"), ("none", "a line\n\nanother line without", "none/a.c")]
    df = spark.createDataFrame(rows, "doc_id string, text string, at string")
    if others:
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        df = df.unionByName(docs.select(F.col("doc_id").cast("string"), "text", licenses.document_paths().alias("at")))
    got = {r.doc_id: r.licence for r in licenses.scan_licenses(df, F.col("at")).where(~F.col("doc_id").rlike("^[0-9]+$")).collect()}
    assert got == {k: COMMON[k] for k in texts} | {"grant": "MIT", "notice": "GPL-2.0", "tag": "MPL-2.0", "none": None}


def test_every_template_has_a_cue():
    assert all(re.search(licenses.CUE, text) for _, text in licenses.TEMPLATES)


def test_secrets(spark):
    r = random.Random(4)
    token = lambda k, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(alphabet) for _ in range(k))
    texts = [f'é password = "{token(8)}" x', "token:abc", f"API_KEY='{token(30)}'", "AKIA" + token(16, "ABCDEF0123456789"), "AKIASHORT", token(40, "0123456789abcdef"), token(23, "0123456789abcdef"), None, "", "word " * 9000]
    texts += ["ſecret: abcdefgh", "secret secret = secret: abcdefgh", f"key {token(44)} end", "id 123e4567-e89b-12d3-a456-426614174000", "sha256-" + token(64, "0123456789abcdef"), "thisisalongordinaryword2 " * 3, "2024-01-01T00:00:00Z/2024-01-02"]
    texts += [" ".join(r.choice(["password=", "a:", "token = ", token(5), token(26), "AKIA" + token(20, "ABC012"), token(24, "abcdef01"), "\n"]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, spans string")
    patterns = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 0, 20), ("hex", "[0-9a-f]+", 0, 0, 24))
    got = secrets.find_secrets(df).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        text = [*texts, texts[0]][row.doc_id] or ""
        force = [(m.start(), k, name, m.end()) for k, (name, p, flags, group, least) in enumerate(patterns) for m in re.finditer(p, text, flags) if len(m[group]) >= least]
        assert [(s.kind, s.start, s.end) for s in row.spans if s.kind != "random"] == [(n, a, b) for a, _, n, b in sorted(force)]
    random_of = {x.doc_id: [texts[x.doc_id][s.start : s.end] for s in x.spans if s.kind == "random"] for x in got if x.doc_id < len(texts)}
    assert random_of[12] == [texts[12].split()[1]] and not any(random_of[i] for i in (13, 14, 15, 16, 9))


def test_random_strings_of_letters_and_behind_words(spark):
    r = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    token = lambda k, alphabet=letters + "0123456789": "".join(r.choice(alphabet) for _ in range(k))
    keys = [token(24, letters) for _ in range(40)] + [token(24) for _ in range(120)]
    around = [""] * 40 + ["/services/production/"] * 40 + ["database-connection-"] * 40 + ["/services/production/"] * 40
    texts = [f"a {a}{k}{'/settings/default' if i >= 120 else ''} b" for i, (a, k) in enumerate(zip(around, keys, strict=True))]
    plain = ["/services/production/database-connection-settings", "/services/production/settings/123e4567-e89b-12d3-a456-426614174000-database-connection-settings-default", "internationalization_of_ordinary_words", "=" * 40, "-" * 5000 + "a"]
    df = spark.createDataFrame(list(enumerate([*texts, *plain])), "doc_id long, text string")
    got = {x.doc_id: [[*texts, *plain][x.doc_id][s.start : s.end] for s in x.spans if s.kind == "random"] for x in secrets.find_secrets(df).collect()}
    assert all(len(got[i]) == 1 and k in got[i][0] for i, k in enumerate(keys))
    assert not any(got[i] for i in range(len(texts), len(texts) + len(plain)))


def planted_secrets(r, n, count):
    """Texts with a random string of n characters each, and texts with words, names and numbers of that length."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(alphabet) for _ in range(n)) for _ in range(count)]
    names = ["python3-dev-tools", "windows11update", "covid19vaccine", "chapter12section3", "tokyo2020olympics", "sha256checksum", "order-123456789", "INV-2023-004512", "isbn9783161484100", "x86_64-linux-gnu", "2024-01-01T00:00:00", "internationalization", "donaudampfschifffahrt", "user_profile_v2_backup", "release-2024-12-31"]
    return keys, [f"it is {k} there" for k in keys], [f"see {name} for more" for name in names]


@pytest.mark.parametrize("n, least", [(12, 0.8), (16, 0.85), (20, 0.95)])
def test_secret_recall_by_length(spark, n, least):
    keys, texts, plain = planted_secrets(random.Random(n), n, 200)
    got = {x.doc_id: x.spans for x in secrets.find_secrets(spark.createDataFrame(list(enumerate([*texts, *plain])), "doc_id long, text string")).collect()}
    hits = sum([(s.kind, s.start, s.end) for s in got[i]] == [("random", 6, 6 + n)] for i in range(len(texts)))
    assert hits >= least * len(texts), hits
    assert [plain[i - len(texts)] for i in range(len(texts), len(got)) if got[i]] == []


def test_secret_query_adds_spans(spark, tmp_path):
    """The registered query on documents with planted strings beside patterns' matches."""
    from terrasift.llm.queries import QUERIES

    keys, texts, plain = planted_secrets(random.Random(9), 20, 50)
    texts = [f"{t} password=abcdefgh" for t in texts]
    spark.createDataFrame(list(enumerate([*texts, *plain])), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {x.doc_id: x for x in QUERIES["op7_secret_scan"](spark, str(tmp_path)).collect()}
    found = [i for i in range(50) if rows[i].spans == f"random:6:26,assign:{texts[i].index('password')}:{len(texts[i])}"]
    assert len(found) >= 47 and all(rows[i].n_assign == 1 for i in range(50)) and not any(rows[50 + k].spans for k in range(len(plain)))


def test_many_secrets_in_one_text_take_time_in_proportion():
    """Thousands of spans of both sorts, and a comparison of each with each would be tens of millions."""
    efficiency = secrets.Efficiency.of(Path(secrets.VOCABULARY).read_bytes())
    text = " ".join(f"token={'abcdefgh'[k % 8] * 6} Qz{k:04}Xw{k * 7919 % 10007:05}Kp{k * 31 % 997:03}Zt" for k in range(6000))
    base = secrets.base_spans(text)
    found = secrets.random_spans(text, efficiency, base)
    assert len(base) == 6000 and len(found) > 3000 and all(text[a - 1] == " " for a, _, _ in found)


def labelled(spark, n=400):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad, low = i % 8 == 0, i % 5 == 0
        words = [r.choice(WORDS) for _ in range(r.choice([20, 60]))]
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vile", "foul", "nasty"]))
        text = " ".join(w + "%%%" if low else w for w in words)
        rows.append((i, text, "s", 0, 0, "k", "l"))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(not low), int(bad)))
    rows += [(n, None, None, None, None, None, None), (n + 1, "", "s", 0, 0, "k", "l"), (n + 2, " ".join(WORDS) * 40, "s", 0, 0, "k", "l"), rows[3], (None, "vile foul nasty", "s", 0, 0, "k", "l")]
    return frame(spark, rows), spark.createDataFrame([*labels, labels[0], (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("busy"))


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, toxicity.learnable())
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is None or r.doc_id < 400:
            assert (r.score >= toxicity.THRESHOLD) == (r.doc_id is None or r.doc_id % 8 == 0), r
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and all(r.doc_id is not None and (r.doc_id >= 400 or r.doc_id % 8) for r in kept.collect())
    used = {i for r in got for i in r.neighbours}
    assert used and not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in used)
    none = toxicity.fit(docs, labels.limit(0), toxicity.learnable())
    assert {r.score for r in toxicity.score_texts(docs, none).collect()} == {0.0}
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_toxicity_counts_copies_of_a_text_once(spark):
    r = random.Random(7)
    words = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    texts = ["one text of its own"] * 300 + [words(20) + " vile" for _ in range(60)] + [words(20) for _ in range(540)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 360)) for i in range(900)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    kept = {x.doc_id for x in toxicity.drop_toxic(docs, model).collect()}
    assert len(model.ids) == len(set(model.ids.tolist())) and not kept & set(range(300, 360)) and kept >= set(range(360, 900))
    assert model.base < 0.15


def test_toxicity_searches_all_terms(spark):
    """A toxic text whose words are too rare to be tied to the label is found by its near copy, and search is exact."""
    r = random.Random(9)
    words = lambda k: [r.choice(WORDS) for _ in range(k)]
    rare = [f"qx{j}" for j in range(12)]
    texts = [" ".join(words(20) + ["vile"]) for _ in range(80)] + [" ".join(words(20)) for _ in range(1000)] + [" ".join(rare)]
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join([*rare[:11], "other"])])), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i < 80 or i == 1080)) for i in range(1081)], "doc_id long, toxic int"), F.lit(True))
    got = {x.doc_id: x for x in toxicity.score_texts(docs, model).collect()}
    assert got[1081].neighbours[0] == 1080 and got[1081].score >= toxicity.THRESHOLD
    dense = np.zeros((1081, len(model.terms)))
    held = lambda x: list(toxicity._vectors(pa.array(x), model.terms))
    for i, term, count in held(texts):
        dense[i, term] = toxicity._weigh(term, count, model.idf)
    for i in (0, 200, 700):
        exact = np.sort(dense @ dense[i])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(got[i].cosines, exact) and got[i].neighbours[0] == i


@pytest.mark.parametrize("head", [1024, 12, 0])
def test_block_max_search_is_exact(monkeypatch, head):
    monkeypatch.setattr(toxicity, "HEAD", head)
    r = np.random.Generator(np.random.PCG64(8))
    rows = [(i, int(r.integers(0, 2)), np.sort(r.permutation(40)[: r.integers(1, 9)]), None) for i in range(900)]
    rows = [(i, y, t, r.integers(1, 5, len(t))) for i, y, t, _ in rows]
    index = toxicity.Examples(np.arange(40, dtype=np.uint64), r.random(40) + 1, rows, 0.1)
    dense = np.zeros((900, 40))
    for i, _, t, c in rows:
        dense[i, t] = toxicity._weigh(t, c, index.idf)
    for _ in range(60):
        term = np.sort(r.permutation(40)[: r.integers(1, 7)])
        query = toxicity._weigh(term, r.integers(1, 4, len(term)), index.idf)
        who, cosine = index.nearest([(term, query)], 25)[0]
        exact = dense[:, term] @ query
        assert np.allclose(np.sort(cosine)[::-1], np.sort(exact[exact > 0])[::-1][:25]) and np.allclose(exact[index.ids[who]], cosine)


def test_toxicity_search_takes_less_than_halving_and_cutting(monkeypatch):
    """Looking words up and adding lists takes well under the time of finding each word by halving and cutting out each list; it
    finds the same neighbours, in steps of one text as well."""
    monkeypatch.setattr(toxicity, "HEAD", 0)
    r = np.random.Generator(np.random.PCG64(10))
    names = np.array(["".join(chr(97 + x) for x in w) for w in r.integers(0, 26, (40000, 7))])
    texts = pa.array([" ".join(names[r.integers(0, 40000, 300)]) for _ in range(2300)])
    words = [toxicity._hashes(Words(data, offsets, ALNUM, lower=True)) for _, _, data, offsets in text_chunks(texts)]
    terms = np.unique(np.concatenate([h for h, _ in words]))
    rows = [(i, i % 2, term, count) for i, term, count in toxicity._vectors(texts.slice(0, 2000), terms)]
    index, asked = toxicity.Examples(terms, np.ones(len(terms)), rows, 0.5), texts.slice(2000)
    index._invert()
    hashes = np.concatenate([toxicity._hashes(Words(data, offsets, ALNUM, lower=True))[0] for _, _, data, offsets in text_chunks(asked)])

    def plain():
        assert (terms[np.searchsorted(terms, hashes)] == hashes).all()
        for _, term, count in held:
            low, high = index.at[term], index.at[term + 1]
            cuts = [slice(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            part = np.concatenate([index.part[c] for c in cuts]) * np.repeat(toxicity._weigh(term, count, index.idf), high - low)
            yield np.bincount(np.concatenate([index.owner[c] for c in cuts]), weights=part, minlength=len(index.ids))

    def seconds(run):
        begin = time.process_time()
        collections.deque(run(), maxlen=0)
        return time.process_time() - begin

    held = list(toxicity._vectors(asked, terms))
    found = list(index.search(asked))
    for (row, _, who, cosine), sums in zip(found, plain(), strict=True):
        assert np.allclose(cosine, np.sort(sums)[::-1][: len(cosine)]) and np.allclose(sums[np.argsort(index.order)[index.ids.searchsorted(who)]], cosine), row
    pairs = [(seconds(lambda: index.search(asked)), seconds(plain)) for _ in range(7)]
    assert min(a for a, _ in pairs) < 0.75 * min(b for _, b in pairs)
    monkeypatch.setattr(toxicity, "HELD", 1)
    assert [(x[0], x[1], x[2].tolist()) for x in index.search(asked)] == [(x[0], x[1], x[2].tolist()) for x in found]


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels, quality.learnable())
    got = quality.score_texts(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == bool(r.doc_id % 5) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(right) / len(right) > 0.98
    again = quality.fit(docs.repartition(5), labels, quality.learnable())
    assert np.allclose(model.weights, again.weights)
    one = quality.fit(docs, labels.where("quality = 1"), quality.learnable())
    assert len({r.score for r in quality.score_texts(docs, one).collect()}) == 1
    assert quality.score_texts(docs, quality.fit(docs.limit(0), labels, quality.learnable())).where("score = 0.5").count() == docs.count()


def test_dual_coordinate_descent_reaches_the_optimum():
    """No small step from the solution lowers the objective."""
    r = np.random.Generator(np.random.PCG64(1))
    rows = [np.sort(r.permutation(30)[: r.integers(2, 8)]) for _ in range(80)]
    y = np.array([int(f[0] < 4) for f in rows])
    scale = np.ones(quality.FEATURES)
    weights, bias = quality.hinge(rows, y, scale, 0.5, 400)
    bound = 0.5 * len(y) / 2 / np.array([(y == 0).sum(), (y == 1).sum()])[y]

    def objective(w, b):
        margin = np.array([w[f].sum() / np.sqrt(len(f)) + b for f in rows]) * np.where(y == 1, 1, -1)
        return 0.5 * (w @ w + b * b) + (bound * np.maximum(0, 1 - margin)).sum()

    best = objective(weights, bias)
    for _ in range(200):
        step = np.zeros_like(weights)
        step[:30] = r.normal(size=30) * 0.01
        assert objective(weights + step, bias + r.normal() * 0.01) >= best - 1e-4


def test_sharding(spark, monkeypatch):
    rows = corpus(9, 500)
    rows += [(10_000 + i, "same words again and again", "s", 0, 0, "", "") for i in range(300)]
    got = sharding.shard(frame(spark, rows), 6).collect()
    assert len(got) == len(rows)
    text = collections.defaultdict(set)
    for r in rows:
        text[r[0]].add((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())))
    load, slots, where = collections.Counter(), collections.defaultdict(list), {}
    for r in got:
        assert (r["size"], r.text_crc32) in text[r.doc_id]
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 6
    assert max(load.values()) - min(load.values()) <= max(0.02 * mean, max(r["size"] for r in got) - mean * 0.7) and len(load) == 6
    small = sum(load.values()) // 6  # a shard
    count = collections.Counter((r["size"], r.text_crc32) for r in got)
    assert all(len(s) == 1 for k, s in where.items() if count[k] * k[0] <= small)
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(frame(spark, rows, 5), 6).collect()))
    assert sharding.shard(frame(spark, [])).count() == 0


def test_groups_stay_whole_up_to_a_shard():
    """Pieces of large groups: whole where that leaves shards equal, in bundles of a shard where they are larger, and cut
    further only where many are nearly as large."""
    pools = [(5.0, 1.0, 1.0)] * 2000
    for sizes, parts in (([900.0, 700.0, 400.0], [1, 1, 1]), ([5200.0, 100.0], [3, 1]), ([600.0] * 10, [1] * 10), ([1800.0] * 12, None)):
        units, group, piece = list(pools), list(range(2000)), [-1] * 2000
        for g, size in enumerate(sizes):
            for k in range(64):
                units.append((size / 64, 1.0, 1.0))
                group.append(10_000 + g)
                piece.append(k)
        units, group, piece = np.array(units), np.array(group), np.array(piece)
        where = sharding.place_groups(units, group, piece, 8)
        load = np.bincount(where, weights=units[:, 0], minlength=8)
        assert load.max() <= 1.02 * load.mean()
        found = [len(set(where[group == 10_000 + g])) for g in range(len(sizes))]
        assert found == parts if parts else max(found) <= 16


def test_place_balances_every_dimension():
    r = np.random.Generator(np.random.PCG64(5))
    units = np.column_stack((r.pareto(1.5, 3000) * 100, r.pareto(1.5, 3000) * 20, np.ones(3000)))
    where = sharding.place(units, 8)
    for column in units.T:
        load = np.bincount(where, weights=column, minlength=8)
        assert load.max() / load.min() < 1.05
