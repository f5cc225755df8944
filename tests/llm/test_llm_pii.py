"""Personal data: patterns against regular expressions, trees on known functions, added spans on planted texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from terrasift.llm import boosting, pii
from terrasift.llm.queries import QUERIES

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def by_force(text):
    def passes(kind, body):
        digits = [int(c) for c in body if c in "0123456789"]
        if kind == 1:
            return all(int(p) <= 255 for p in body.split("."))
        if kind == 2:
            doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if passes(k, m[0]))


def test_base_spans_are_what_the_patterns_match():
    r = random.Random(3)
    pieces = ["a", "b.c", "@", "@@", ".", "-", "+", " ", "1", "22", "255", "256", "000", "4111111111111111", "(", ")", "x@y.z", "+1 ", "é", "٣", "\n", "1.2.3.4", "x@-.-"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert pii.base_spans(text) == by_force(text), text


def test_long_texts_take_time_in_proportion():
    """Runs that make the plain patterns take the square of their length."""
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "a@" * 200_000, "12 " * 60_000, "a@b." * 50_000, " at " * 60_000 + " dot "):
        base = pii.base_spans(text)
        assert isinstance(base, list) and isinstance(pii.proposals(text[:60_000]), list)


def test_trees_learn_and_line_calibrates():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.2)).astype(float)
    trees = boosting.fit(x[:3000], y[:3000])
    margin = trees.margins(x[3000:])
    assert ((margin > 0) == y[3000:]).mean() > 0.97
    a, b = boosting.platt(margin, y[3000:])
    p = 1 / (1 + np.exp(-(a * margin + b)))
    assert a > 0 and abs(p.mean() - y[3000:].mean()) < 0.01
    again = boosting.fit(x[:3000], y[:3000])
    assert (again.leaves == trees.leaves).all() and (again.edges == trees.edges).all()
    assert len(boosting.fit(x[:5], np.zeros(5)).margins(x[:0])) == 0


def test_least_score():
    scores, y = np.array([0.9, 0.9, 0.8, 0.7, 0.2]), np.array([1, 0, 1, 1, 1])
    assert pii.least_score(scores, y, 0.99) > 1 and pii.least_score(scores, y, 0.7) == 0.7
    assert pii.least_score(scores[2:], y[2:], 0.99) == 0.7 and pii.least_score(scores[:0], y[:0], 0.9) > 1


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def planted(kind, r):
    """(text, or None if there is none to find) in ways of writing that the patterns don't take."""
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == 0:
        name, host = r.choice(["anna.berg", "j_doe", "info", "maria.lopez7"]), r.choice(["example", "uni-mail", "firma"])
        return r.choice([f"{name} [at] {host} [dot] com", f"{name}(at){host}(dot)org", f"{name} at {host} dot de", f"{name} @ {host}.net"])
    if kind == 1:
        return r.choice(["[.]", "(.)", "[dot]"]).join(str(r.randrange(1, 256)) for _ in range(4))
    if kind == 2:
        body = "4" + digit(14)
        body += next(c for c in "0123456789" if pii.luhn(body + c))
        return r.choice([".", "/", " "]).join(body[k : k + 4] for k in (0, 4, 8, 12))
    a, b, c = digit(3), digit(3), digit(4)
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}", f"{a}.{b}.{c}"])


def test_added_spans_on_planted_texts(model):
    """Recall by kind on forms that no pattern takes, and no span in texts with numbers and words that are no such data."""
    r = random.Random(11)
    words = lambda n: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(n))
    for kind, least in ((0, 0.9), (1, 0.9), (2, 0.8), (3, 0.9)):
        hit = 0
        for _ in range(200):
            before, body = words(6) + " ", planted(kind, r)
            text = f"{before}{body} {words(5)}"
            base = pii.base_spans(text)
            found = base + [s[:3] for s in pii.added_spans(text, base, model)]
            hit += (len(before), kind, len(before) + len(body)) in found
        assert hit >= least * 200, (pii.KINDS[kind], hit)
    wrong = 0
    for _ in range(400):
        number = r.choice([f"20{r.randrange(10, 30)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", f"{r.randrange(100)}.{r.randrange(1000)}", f"{r.randrange(1, 100)},{r.randrange(100, 1000)},{r.randrange(100, 1000)}", f"v{r.randrange(9)}.{r.randrange(30)}.{r.randrange(30)}", f"{r.randrange(10, 24)}:{r.randrange(10, 60)}:{r.randrange(10, 60)}", f"at {r.choice(['noon', 'home', 'the door'])}. Then", str(r.randrange(10**6))])
        wrong += bool(pii.added_spans(f"{words(6)} {number} {words(4)}", [], model))
    assert wrong <= 4


def test_added_spans_touch_no_base_span_and_not_each_other(model):
    text = "4111111111111111 4111111111111111 or x@y.com (at) z.com, +1 (017) 555-7713 190.137.223.204 and (017) 555-7713"
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, model)
    every = sorted([*base, *(s[:3] for s in added)])
    assert added and all(a[2] <= b[0] for a in every for b in added if a != b[:3] and a[0] <= b[0])
    assert pii.added_spans(text, base, pii.Model(None, (1.0, 0.0), (2.0,) * 4)) == []


def test_registered_query(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op11_personal_data"](spark, data).collect()
    assert len(rows) == len(texts) and any(r.spans for r in rows)
    for r in rows:
        base = by_force(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(joined.split(",")) <= {*r.spans.split(","), ""}


def test_odd_rows_and_redaction(spark, model):
    rows = [(1, "mail a@b.com and 1.2.3.4 end", "k"), (2, None, "k"), (3, "", "k"), (4, "é" * 5000 + " a@b.com", "k"), (5, "plain", "k"), (None, "x@y.org", None), (1, "mail a@b.com and 1.2.3.4 end", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)
    found = pii.find_personal_data(docs, model)
    spans = sorted(((r.doc_id or 0), tuple((s.kind, s.start, s.end, s.base) for s in r.spans)) for r in found.collect())
    first = (("email", 5, 12, True), ("ip", 17, 24, True))
    assert spans == [(0, (("email", 0, 7, True),)), (1, first), (1, first), (2, ()), (3, ()), (4, (("email", 5001, 5008, True),)), (5, ())]
    clean = {r.doc_id: r.text for r in pii.redacted(docs.drop("spans").where("doc_id in (1, 2, 3, 4, 5)").distinct(), found.where("doc_id is not null").distinct()).collect()}
    assert clean == {1: "mail <email> and <ip> end", 2: None, 3: "", 4: "é" * 5000 + " <email>", 5: "plain"}
    empty = spark.createDataFrame([], docs.schema)
    assert pii.find_personal_data(empty).collect() == [] and pii.fit(docs.where("doc_id = 5")).trees is None
