"""Personal data in whole texts: generators propose spans, boosted trees score them, calibrated thresholds select.

Four patterns fix the base spans, which always stay. Generators propose more: addresses with spelled or spaced signs,
numbers with other separators, parts of digit runs that a pattern took as one and dropped, telephone numbers without a
country's sign, IPv6. Proposals overlap, and most are none. Trees see how a proposal is written and what stands around it.
They learn from proposals in a bounded sample of the documents: those that are base spans are right, and base spans are
also written anew in their own surroundings, right and with mistakes; everything else proposed there is wrong.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .words import text_chunks

KINDS = ("email", "ip", "card", "phone")
#: Documents that are read to learn from, and proposals of them that are learned from, at most.
SAMPLE_DOCS, SAMPLE_ROWS = 4096, 24576
#: Of the selected proposals of a kind, at least this share has to be right on the rows kept for calibration.
PRECISION = 0.99
#: Code points before and after a proposal that its features see.
AROUND = 40

_AT = re.compile("@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]++\Z")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_TELLING = np.zeros(256, dtype=bool)
_TELLING[[*b"0123456789@([{<"]] = True

Span = tuple[int, int, int]  # start, number of kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' own matches, leftmost and non-overlapping in each kind, without those that fail its test.

    Addresses are found from their signs, so that a long run of letters without one costs no more than its length.
    """
    spans, done = [], 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _DOMAIN.match(text, at + 1)):
            spans.append((start, 0, done := host.end()))
        else:
            done = max(done, at)  # no local part reaches over a sign
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(spans)


# --- generators ----------------------------------------------------------------------------------------------------------

_SIGN = re.compile(r"[@(\[{<](?:(?<=@)|\s?at\s?[)\]}>])\s{0,2}", re.IGNORECASE)
_SPELLED = re.compile(r"\s{1,2}at\s{1,2}", re.IGNORECASE)
_SPELLED_DOT = re.compile(r"\sdot\s", re.IGNORECASE)
_DOT = r"(?:\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\s{1,2}dot\s{1,2}|\s?\.\s?)"
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", re.IGNORECASE)
_NAME = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}\Z", re.IGNORECASE)
_QUAD = re.compile(r"[0-9](?<![0-9.][0-9])[0-9]{0,2}(?:\s?[(\[]?(?:\.|dot)[)\]]?\s?[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_CHUNK = re.compile(r"[0-9]+")
#: What may stand between the chunks of one number.
_BETWEEN = re.compile(r"[\x20.\-/_()  ‑–·]{1,3}")


def _addresses(text: str) -> Iterator[Span]:
    signs = []
    for m in _SIGN.finditer(text):
        at = m.start()
        while m.start() - at < 2 and at and text[at - 1].isspace():
            at -= 1
        signs.append((at, m.end()))
    if _SPELLED_DOT.search(text):
        signs += [m.span() for m in _SPELLED.finditer(text)]
    for at, after in signs:
        host = _HOST.match(text, after, after + 256)
        if host and (name := _NAME.search(text[max(0, at - 80) : at])):
            begin = at - len(name[0])
            labels = [after + k.end() for k in re.finditer(r"[A-Za-z0-9-]+", host[0])]
            ends = {host.end(), *labels[1:]}
            begins = {begin + k.start() for k in re.finditer(r"[A-Za-z0-9._%+-]+", name[0]) if k.end() == len(name[0])} | {begin}
            yield from ((a, 0, b) for a in begins for b in ends)


def _numbers(text: str) -> Iterator[Span]:
    """Cards and telephone numbers: neighbouring chunks of digits with up to 19 digits in all."""
    chunks = [m.span() for m in _CHUNK.finditer(text) if m.end() - m.start() <= 19]
    tied = [bool(_BETWEEN.fullmatch(text, a[1], b[0])) for a, b in zip(chunks[:-1], chunks[1:], strict=True)]
    for i, (start, _) in enumerate(chunks):
        digits = 0
        lead = start - 1 if start and text[start - 1] in "+(" else start
        lead -= lead < start and lead > 0 and text[lead] == "(" and text[lead - 1] == "+"
        for j in range(i, len(chunks)):
            if j > i and not tied[j - 1]:
                break
            digits += chunks[j][1] - chunks[j][0]
            if digits > 19:
                break
            end = chunks[j][1]
            if digits >= 12:
                yield start, 2, end
            if 7 <= digits <= 15 and (j > i or lead < start or digits >= 9):
                yield lead, 3, end


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data, in order; they overlap. None begins or ends inside a run of letters or digits."""
    found = {*_addresses(text), *((m.start(), 1, m.end()) for m in _QUAD.finditer(text)), *_numbers(text)}
    if "::" in text or text.count(":") > 6:
        found |= {(m.start(), 1, m.end()) for m in _COLONS.finditer(text) if ("::" in m[0] or m[0].count(":") == 7) and _digits(m[0])}
    return sorted(s for s in found if not (s[0] and text[s[0] - 1].isalnum() and text[s[0]].isalnum()) and not (s[2] < len(text) and text[s[2]].isalnum()))


# --- features ------------------------------------------------------------------------------------------------------------

#: Words that stand near data of a kind, in four languages, and near numbers that are none.
_CUES = (
    ("email", "mail", "contact", "contacto", "write", "correo", "courriel", "adresse"),
    ("ip", "host", "server", "address", "client", "login", "servidor", "serveur"),
    ("card", "visa", "mastercard", "amex", "credit", "tarjeta", "carte", "karte"),
    ("tel", "phone", "call", "fax", "mobile", "telefon", "telephone", "llame"),
)
_NOT = ("order", "invoice", "isbn", "issn", "version", "date", "serial", "tracking", "page", "no", "id", "ref", "article", "build")
_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ru", "cn", "jp", "co", "it", "nl", "ch")
_WORD = re.compile(r"[^\W\d_]+")


_CUT = re.compile(r"\s?(?:@|[(\[{<]\s?at\s?[)\]}>])\s?|\sat\s")


def _address_features(body: str, before: str, after: str) -> list[float]:
    name, *host = _CUT.split(body, maxsplit=1)
    host = host[0] if host else ""
    more = re.match(r"(?:\.|\s?[(\[{<]\s?dot|\sdot\s)\s?[A-Za-z0-9]", after)
    return [len(name), float(" " in name or "\n" in name), len(re.findall(r"[a-z0-9-]+", host)), float(bool(re.search(r"\.\s|\s\.", host))), float(bool(more)), float(bool(re.search(r"[.)\]}>_%+-]\Z", before)))]


def features(text: str, span: Span) -> list[float]:
    """How a proposal is written, and what stands around it."""
    start, kind, end = span
    body, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = _digits(body)
    groups = [len(g) for g in _CHUNK.findall(body)] or [0]
    lower = body.lower()
    near = {w.lower() for w in _WORD.findall(before[-24:])}
    spelled = float("dot" in lower) + 2 * float(bool(re.search(r"[(\[{<]\s?(?:at|dot)", lower)))
    last = re.split(r"[^a-z0-9-]+", lower)[-1]
    pairs = list(zip(groups[:-1], groups[1:], strict=True))
    try:
        host = float(kind == 1 and bool(ipaddress.ip_address(re.sub(r"[()\[\]\s]|dot", lambda m: "." if m[0] == "dot" else "", lower.replace("[.]", ".").replace("(.)", ".")))))
    except ValueError:
        host = 0.0
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(body), len(digits), len(groups), min(groups), max(groups), groups[0], groups[-1],
        sum(a == b for a, b in pairs), float(groups[:-1] == [4] * (len(groups) - 1)),
        body.count(" "), body.count("."), body.count("-"), body.count("("), body.count("/") + body.count("_"), float(body.count("(") == body.count(")")),
        float(body[:1] == "+"), float(digits[:2] == "00"), float(before[-1:] in ("+", "(")), float(12 <= len(digits) <= 19 and luhn(digits)), float(digits[:1] in ("3", "4", "5", "6") and len(digits) > 0), len(set(digits)),
        host, lower.count(":"), float(bool(re.match(r"(?:19|20)\d\d\D[01]?\d\D[0-3]?\d$|[0-3]?\d\D[01]?\d\D(?:19|20)\d\d$", body))),
        float("@" in body), spelled, sum(c.isalpha() for c in body), float(last in _ENDS), len(last), float(bool(re.search(r"\s(?:at|@)\s", lower))),
        float(bool(re.match(r"[\w.%+-]*[\d._]", lower.split("@")[0].split(" at ")[0][:64]))),
        *_address_features(lower, before, after), *(float(bool(near & set(words))) for words in _CUES), float(bool(near & set(_NOT)) or before[-1:] in ("#", "$", "€", "£")),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), len(_digits(before)), len(_digits(after)),
        float(bool(re.match(r"[\x20.\-/()]{0,2}\d", after))), float(bool(re.search(r"\d[\x20.\-/()]{0,2}\Z", before))), float(after[:1] in ("%", "°", "€", "$")),
    ]


# --- what is learned from ------------------------------------------------------------------------------------------------


def _regrouped(digits: str, sizes: tuple[int, ...], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join([*out, digits[at:]] if at < len(digits) else out)


def rewritings(kind: int, body: str) -> Iterator[tuple[str, bool]]:
    """Other ways to write a base span, each with whether it is still one."""
    digits = _digits(body)
    if kind == 0:
        name, _, host = body.partition("@")
        plain = re.sub(r"[^A-Za-z]", "", name) or "they"
        end = _ENDS[len(body) % len(_ENDS)]
        names = (name, plain, f"{plain[:1]}.{plain[1:]}" if len(plain) > 1 else plain, f"{plain}_{len(body)}")
        hosts = (host, ".".join(host.split(".")[-2:]), f"{plain[::-1]}.{end}", f"mail.{plain[:6]}.{end}")
        for k, (sign, dot) in enumerate(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), ("[at]", "."), (" (at) ", " dot "), (" at ", " dot "), (" [at] ", "."))):
            yield names[(k + len(body)) % 4] + sign + hosts[(k + len(name)) % 4].replace(".", dot), True
        yield f"{plain} at {host.replace('.', '. ').title()}", False
        yield f"{plain} at the dot", False
    elif kind == 1:
        parts = body.split(".")
        for sep in ("[.]", "(.)", " . ", "[dot]"):
            yield sep.join(parts), True
        yield ".".join([*parts[:3], str(int(parts[3]) + 256)]), False
        yield "[.]".join([str(int(parts[0]) + 300), *parts[1:]]), False
        hexes = [f"{int(a) * 256 + int(b) + 4096:x}" for a, b in zip(parts, parts[1:] + parts[:1], strict=True)]
        yield ":".join(hexes + hexes[::-1]), True
        yield f"{hexes[0]}:{hexes[1]}::{hexes[2]}", True
        yield ":".join(f"{int(p):02x}" for p in parts + parts[:2]), False
    elif kind == 2:
        wrong = str((int(digits[0]) + 1) % 10) + digits[1:]
        for sep in (" ", "-", ".", "/", " ", "  "):
            yield _regrouped(digits, (4, 4, 4), sep), True
            yield _regrouped(wrong, (4, 4, 4), sep), False
        yield digits, True
        yield wrong, False
        yield _regrouped(digits[:-2], (4, 4, 4), " "), luhn(digits[:-2]) and len(digits) > 15
        yield _regrouped(digits, (1, 6, 2, 5), "-"), False
    else:
        own = digits[-10:]
        code, a, b, c = digits[:-10] or "1", own[:3], own[3:6], own[6:]
        yield body, True
        for sep in (" ", "-", "."):
            yield f"({a}){sep.strip('.')}{b}{sep}{c}", True
            yield sep.join((a, b, c)), True
            yield sep.join((code, a, b, c)), True
            yield sep.join((f"00{code}", a, b, c)), True
            yield f"+{code}/{a}{sep}{b}{c}", True
        for text in (f"20{own[:2]}-{int(own[2:4]) % 12 + 1:02}-{int(own[4:6]) % 28 + 1:02}", f"{int(own[4:6]) % 28 + 1:02}.{int(own[2:4]) % 12 + 1:02}.20{own[:2]}", own, f"{own[:1]}.{own[1:]}", f"{own[:2]} {own[2:4]} {own[4:6]} {own[6:8]} {own[8:]}", f"978-{own[:1]}-{own[1:4]}-{own[4:9]}-{own[9:]}", f"{own[:5]}-{own[5:]}", f"{own[:3]},{own[3:6]},{own[6:9]}"):
            yield text, False


def examples(text: str) -> Iterator[tuple[list[float], int]]:
    """(features, 1 if right) of the proposals in a text, and in what its base spans are written anew to. Proposals inside
    a match that a pattern took and dropped are neither right nor wrong."""
    base = set(base_spans(text))
    dropped = [m.span() for p in (_IP, _CARD, _PHONE) for m in p.finditer(text)]
    dropped = sorted(d for d in dropped if not any((d[0], k, d[1]) in base for k in range(1, len(KINDS))))
    for s in proposals(text):
        k = bisect_left(dropped, (s[0] + 1,)) - 1
        if s in base or k < 0 or not any(b >= s[2] for _, b in dropped[max(0, k - 2) : k + 1]):
            yield features(text, s), int(s in base)
    for k, (start, kind, end) in enumerate(sorted(base)):
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        for i, (form, right) in enumerate(rewritings(kind, text[start:end])):
            turn = (k + i) % 4
            cue = "" if turn < 2 else f"{_CUES[kind][(k + i) % 8]}: " if right or turn == 3 else f"{_NOT[(k + i) % len(_NOT)]} "
            tail = ("" if kind < 2 or turn != 1 else f" {len(before) * 37 + i}" if i % 2 else f" {form}")  # another number
            written = f"{before}{cue}{form}{tail}{after}"
            at = len(before) + len(cue)
            mine = (at, kind, at + len(form))
            for s in proposals(written):
                if s[0] < mine[2] and mine[0] < s[2]:
                    yield features(written, s), int(right and s == mine)


@dataclass
class Model:
    """Trees, the line that makes margins probabilities, and the least probability of each kind."""

    trees: boosting.Boosted | None
    line: tuple[float, float]
    least: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.trees.margins(x) * self.line[0] + self.line[1])))


def least_score(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score, of 0.5 or more, from which on at least that share is right; over 1 if there is none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True) if len(y) else np.zeros(0, dtype=bool)  # equal scores go together
    good = np.flatnonzero((right >= precision) & last & (scores[order] >= 0.5))
    return float(scores[order][good[-1]]) if len(good) else 2.0


def _has_data(text: Column) -> Column:
    return text.rlike(r"@|[0-9][^A-Za-z]{0,3}[0-9]|[(\[]\s?at\s?[)\]]")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = SAMPLE_DOCS, most_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> Model:
    """Trees fitted on at most most_rows proposals in at most most_docs documents, both those first in hashed order.

    Proposals become features where the documents are; the driver gets numbers only. A third of the rows is kept apart
    to calibrate on. Without a right proposal there is a model that selects none.
    """
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = texts.where(_has_data(F.col("text")) & F.col("id").isNotNull()).select("id").distinct()
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(most_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                if rows := list(examples(text.as_py() or "")):
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.list_(pa.float32())), pa.array([y for _, y in rows], pa.int32())], ["x", "y"])

    rows = texts.join(F.broadcast(picked), "id", "left_semi").mapInArrow(run, "x array<float>, y int")
    rows = rows.select("x", "y", F.xxhash64("x", "y").alias("h")).distinct().orderBy("h", "y").limit(most_rows).toPandas()
    if not len(rows) or rows.y.nunique() < 2:
        return Model(None, (1.0, 0.0), (2.0,) * len(KINDS))
    x, y = np.stack(rows.x.to_numpy()).astype(float), rows.y.to_numpy().astype(float)
    kept = (rows.h.to_numpy() & 0xFFFF) % 3 == 0
    if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        kept = np.zeros(len(y), dtype=bool)
    trees = boosting.fit(x[~kept], y[~kept])
    apart = kept if kept.any() else ~kept
    line = boosting.platt(trees.margins(x[apart]), y[apart])
    model = Model(trees, line, ())
    scores = model.scores(x[apart])
    model.least = tuple(least_score(scores[of], y[apart][of], precision) for k in range(len(KINDS)) for of in [x[apart][:, k] == 1])
    return model


def added_spans(text: str, base: list[Span], model: Model) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of the proposals that reach their kind's threshold, the best first where they overlap;
    none touches a base span."""
    if model.trees is None:
        return []
    starts, far, free = [b[0] for b in base], [], []
    for b in base:
        far.append(max(b[2], far[-1] if far else 0))
    for s in proposals(text):
        k = bisect_left(starts, s[2])  # base spans that begin before it ends
        if not k or far[k - 1] <= s[0]:
            free.append(s)
    if not free:
        return []
    scores = model.scores(np.array([features(text, s) for s in free]))
    good = sorted((-round(float(p), 9), s[0] - s[2], s) for s, p in zip(free, scores, strict=True) if p >= model.least[s[1]])
    taken: list[tuple[int, int, int, float]] = []
    used: set[int] = set()
    for p, _, (a, k, b) in good:  # a proposal has at most some hundreds of places
        if used.isdisjoint(range(a, b)):
            used.update(range(a, b))
            taken.append((a, k, b, -p))
    return taken


def _likely(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts that can have a base span or a proposal: with a digit, a sign, a bracket or the word dot."""
    hits = [np.flatnonzero(_TELLING[data])]
    low = (data | 0x20) if len(data) > 2 else np.zeros(2, dtype=np.uint8)
    hits.append(np.flatnonzero((low[:-2] == 0x64) & (low[1:-1] == 0x6F) & (low[2:] == 0x74)))
    return np.unique(np.searchsorted(offsets, np.concatenate(hits), side="right") - 1).tolist()


def find_personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<kind, start, end, base, score>>) for every row of docs, by start, then in the order of KINDS.

    Offsets are code points, end exclusive. Base spans are the patterns' own matches; the others are what the model,
    fitted on docs if none is given, selects beside them. A null or empty text has no spans. Other columns aren't read;
    rows may repeat, and rows without an id are scanned as well, but not learned from.
    """
    model = model or fit(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spans = batch.column("text"), [[]] * len(batch)
            for low, _, data, offsets in text_chunks(column):
                for row in _likely(data, offsets):
                    text = column[low + row].as_py()
                    base = base_spans(text)
                    found = [(*s, 1.0) for s in base] + added_spans(text, base, held.value)
                    fixed = set(base)
                    spans[low + row] = [{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in fixed, "score": p} for a, k, b, p in sorted(found)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], ["id", "spans"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    return out.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each found span of a text replaced by its kind in angle brackets; of overlapping spans the first, and of
    those the longest. found has a row for each id; a null text stays null."""
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    spans = found.select(F.col(id_col).alias("__id"), order.alias("__spans"))
    text = F.col(text_col)
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["back"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out")))
    done = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    both = docs.join(spans, F.col(id_col) == F.col("__id"), "left")
    return both.withColumn(text_col, F.when(F.size("__spans") > 0, done).otherwise(text)).drop("__id", "__spans")
