"""Registered queries on the driver's smallest tables: against their SQL, or against brute force where there is none."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from terrasift.llm import toxicity
from terrasift.llm.durable import written
from terrasift.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def normal(value):
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, data, name):
    frame = QUERIES[name](spark, data)
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
        cursor = db.execute(ORACLES[name])
        columns, rows = [c[0] for c in cursor.description], cursor.fetchall()
    assert sorted(columns) == sorted(frame.columns)
    order = [columns.index(c) for c in frame.columns]
    assert collections.Counter(repr(tuple(map(normal, r))) for r in frame.collect()) == collections.Counter(repr(tuple(normal(r[i]) for i in order)) for r in rows)


def documents(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_secret_query(spark, data):
    texts = documents(spark, data)
    rows = QUERIES["op7_secret_scan"](spark, data).collect()
    assert len(rows) == len(texts)
    patterns = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 0, 20), ("hex", "[0-9a-f]+", 0, 0, 24))
    for r in rows:
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, f, g, least) in enumerate(patterns) for m in re.finditer(p, texts[r.doc_id], f) if len(m[g]) >= least)
        joined = ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _, _ in spans) for i in range(3))
        assert set(joined.split(",")) <= {*r.spans.split(","), ""}


@pytest.mark.parametrize("name, label, modulus, held", [("op6_toxicity", "toxic", 4, 2), ("op8_quality_classifier", "quality", 5, 0)])
def test_classifiers_on_held_out_rows(spark, name, label, modulus, held):
    data = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES[name](spark, data).collect()}
    assert len(rows) == 1000
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    known = {x.doc_id: x[label] for x in spark.read.parquet(f"{data}/labels.parquet").collect()}
    right = [rows[i].predicted == y for i, y in known.items() if rows[i].held_out]
    assert sum(right) / len(right) > 0.9
    rare = 1 if name == "op6_toxicity" else 0  # the label that few have, which guessing the other never finds
    found = [rows[i].predicted == y for i, y in known.items() if rows[i].held_out and y == rare]
    assert sum(found) / len(found) > 0.6
    scores = [(rows[i].score, y) for i, y in known.items() if rows[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in scores for b, y in scores if x > y]
    assert sum(pairs) / len(pairs) > (0.8 if name == "op6_toxicity" else 0.95)  # area under the curve


def test_toxicity_query_finds_the_nearest(spark, data):
    """Neighbours of every document against dense cosines of all examples; every text with a term of theirs has some."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"), toxicity.learnable())
    texts = documents(spark, data)
    dense = lambda some: {i: v for i, v in ((i, next(iter(toxicity._vectors(pa.array([texts[i]]), model.terms)), None)) for i in some) if v}
    examples = np.zeros((len(model.ids), len(model.terms)))
    for i, (_, term, count) in dense(model.ids.tolist()).items():
        examples[model.ids.tolist().index(i), term] = toxicity._weigh(term, count, model.idf)
    vectors, found = dense(texts), {r.doc_id: r.neighbours for r in QUERIES["op6_toxicity"](spark, data).collect()}
    for i, (_, term, count) in vectors.items():
        cosines = examples[:, term] @ toxicity._weigh(term, count, model.idf)
        order = np.lexsort((model.ids, -np.round(cosines, 12)))[: toxicity.NEIGHBOURS]
        assert found[i] == model.ids[order[cosines[order] > 0]].tolist() and found[i]
    assert all(not found[i] for i in texts if i not in vectors)


def test_packing_query(spark, data):
    texts = documents(spark, data)
    rows = QUERIES["op10_vector_bin_packing"](spark, data).collect()
    assert {(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None) for i, t in texts.items()}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    load = collections.Counter()
    for r in QUERIES["op10_vector_bin_packing"](spark, "/root/testdata/sf0.01").collect():
        load[r.shard] += r["size"]
    assert len(load) == 24 and max(load.values()) <= 1.02 * sum(load.values()) / 24
    texts_of = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    shards = collections.defaultdict(set)
    for r in QUERIES["op10_vector_bin_packing"](spark, "/root/testdata/sf0.01").collect():
        shards[texts_of[r.doc_id]].add(r.shard)
    assert any(list(texts_of.values()).count(t) > 1 for t in shards) and all(len(s) == 1 for s in shards.values())  # none is as large as a shard
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_against_brute_force(spark, data):
    """Every stage on its predecessor's rows: none is lost that has to stay, none stays that has to go."""
    from test_llm_operators import jaccard_by_force, leaks_by_force

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], data).collect(), docs.schema))
        assert kept[-1].columns == columns
    before, clean, unique, pure, mixed = ([(r.doc_id, r.text) for r in k.collect()] for k in kept)
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"), toxicity.learnable())
    toxic = {r.doc_id for r in toxicity.score_texts(docs, model).collect() if r.score >= 0.3}
    assert sorted(clean) == sorted(x for x in before if x[0] not in toxic)
    assert sorted(x[0] for x in unique) == sorted({c for _, _, c in jaccard_by_force(clean)})
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert sorted(x[0] for x in pure) == sorted(int(i) for i, _, hit, _ in leaks_by_force(unique, items) if not hit)
    assert {x for x in mixed} <= set(pure) and max(collections.Counter(mixed).values()) <= 3
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in rows)
    assert abs(words(mixed) - words(pure)) < 0.02 * words(pure)
    stored = written(corpus_pipeline.STAGES[3][1](spark, kept[3], data), "mixed")
    place = {}
    for k, r in enumerate(stored.orderBy("_metadata.file_path", "_metadata.row_index").select("doc_id").collect()):
        place.setdefault(r.doc_id, []).append(k)
    for _, shard in itertools.groupby(sorted(corpus_pipeline.STAGES[-1][1](spark, stored, data).collect(), key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        at = -1  # slots follow the order of the mix
        for r in shard:
            at = min(k for k in place[r.doc_id] if k > at)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], data)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(x[0] for x in mixed)
    assert corpus_pipeline.run(spark, data).count() == len(mixed)
