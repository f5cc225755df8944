"""Secret scans of whole texts: patterns, and strings that a tokenizer finds inefficient.

Random strings fall into short tokens under a vocabulary learned from text. A run of key characters with few
characters per token is a secret unless it is a digest or an identifier of a known form; so is such a stretch between words.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, text_chunks

#: tiktoken vocabulary: a line of base64 token and rank each.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenization pattern of that vocabulary.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of fewer characters aren't tested; a run with more characters per token than this is text. A run under LONG, of
#: which there are too few tokens to tell much, needs letters and digits and still fewer characters per token.
LEAST, LONG, RATIO, SHORT_RATIO = 12, 20, 2.0, 1.75

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS, _HEX, _RUN = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}"), re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Digests by their hexadecimal lengths (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), with an algorithm's name or not; UUIDs; dates, plain numbers, and numbers behind a few letters.
_KNOWN = re.compile(r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=/])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9TZ_/+-]+|[a-z]{1,6}[-_/]?[0-9][0-9_/-]*", re.IGNORECASE | re.ASCII)

_PART = re.compile(r"[^/=_-]+")

_RUN_BYTES = np.zeros(256, dtype=np.uint8)
_RUN_BYTES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = 1
_HEX_BYTES = np.zeros(256, dtype=np.uint8)
_HEX_BYTES[[*b"0123456789abcdef"]] = 1


class Efficiency:
    """Characters per token under a vocabulary; built once in each Python process."""

    _built: dict[int, Efficiency] = {}

    def __init__(self, lines: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, lines: bytes) -> Efficiency:
        key = hash(lines)
        if key not in cls._built:
            cls._built[key] = cls(lines)
        return cls._built[key]

    def ratio(self, text: str) -> float:
        return len(text) / len(self.encoding.encode_ordinary(text))


def base_spans(text: str, kinds: tuple[str, ...] = KINDS[:3]) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the pattern matches, leftmost and non-overlapping in each kind."""
    spans = []
    if "assign" in kinds:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in kinds:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if "hex" in kinds:
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return spans


def is_candidate(run: str) -> bool:
    letters = any(c.isalpha() for c in run)
    return letters and len(run) >= LEAST and (len(run) >= LONG or any(c.isdigit() for c in run)) and not _KNOWN.fullmatch(run)


def is_random(run: str, efficiency: Efficiency) -> bool:
    return is_candidate(run) and efficiency.ratio(run) <= (RATIO if len(run) >= LONG else SHORT_RATIO)


def stretches(run: str, efficiency: Efficiency) -> list[tuple[int, int]]:
    """(start, end) in a run of what is random: the whole, or what is left without the words around it, or else parts
    between separators. A known form between words is no secret, nor are its parts."""
    random = lambda a, b: is_random(run[a:b], efficiency)
    if _KNOWN.fullmatch(run):
        return []
    parts = [m.span() for m in _PART.finditer(run)]
    if random(0, len(run)):
        return [(0, len(run))]
    word = lambda p: run[p[0] : p[1]].isalpha() and efficiency.ratio(run[p[0] : p[1]]) > RATIO
    first, last = 0, len(parts)
    while first < last and word(parts[first]):
        first += 1
        if first < last and _KNOWN.fullmatch(run, parts[first][0], parts[-1][1]):
            return []
    while first < last and word(parts[last - 1]):
        last -= 1
        if first < last and _KNOWN.fullmatch(run, parts[first][0], parts[last - 1][1]):
            return []
    if first < last and random(parts[first][0], parts[last - 1][1]):
        return [(parts[first][0], parts[last - 1][1])]
    return [p for p in parts if random(*p)]


def random_spans(text: str, efficiency: Efficiency, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs, or stretches of them, with few characters per token that touch none of the spans taken."""
    starts, far, found = [], [], []
    for start, _, end in sorted(taken):
        starts.append(start)
        far.append(max(end, far[-1] if far else 0))  # the furthest end of the spans up to this one
    for m in _RUN.finditer(text):
        run = m[0]
        if any(c.isalpha() for c in run) and (len(run) >= LONG or any(c.isdigit() for c in run)):
            for a, b in stretches(run, efficiency):
                k = bisect_left(starts, m.start() + b)  # spans that begin before the stretch ends
                if not k or far[k - 1] <= m.start() + a:
                    found.append((m.start() + a, 3, m.start() + b))
    return found


def _rows_with(lowered: bytes, needles: tuple[bytes, ...], offsets: np.ndarray) -> set[int]:
    """Texts in whose bytes a needle begins; one that crosses texts does no harm, as the pattern then fails."""
    rows = set()
    for needle in needles:
        at = lowered.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            rows.add(row)
            at = lowered.find(needle, max(at + 1, int(offsets[row + 1]) - len(needle)))
    return rows


def _likely(data: np.ndarray, offsets: np.ndarray) -> dict[int, set[str]]:
    """The kinds of spans that a text can have, by cheap necessary conditions on its bytes."""
    lowered = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8).tobytes()
    out: dict[int, set[str]] = {}
    for kind, rows in (("assign", _rows_with(lowered, _WORDS, offsets)), ("access", _rows_with(data.tobytes(), (b"AKIA",), offsets))):
        for row in rows:
            out.setdefault(row, set()).add(kind)
    digits = np.concatenate(([0], np.cumsum((data >= 0x30) & (data <= 0x39))))
    for kind, table in (("hex", _HEX_BYTES), ("random", _RUN_BYTES)):
        runs = Words(data, offsets, table, lower=False)
        size = runs.end - runs.start
        keep = size >= 24 if kind == "hex" else (size >= LONG) | ((size >= LEAST) & (digits[runs.end] > digits[runs.start]))
        for row in np.unique(runs.row_of_word()[keep]).tolist():
            out.setdefault(row, set()).add(kind)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>) for every row of docs, by start, then in the order of KINDS.

    Offsets are code points, end exclusive. Kinds other than random are the patterns' own matches and always stay; a
    random span is added where it touches none of these. A null or empty text has no spans. Other columns aren't read;
    rows may repeat.
    """
    with open(vocabulary, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spans = batch.column("text"), [[]] * len(batch)
            for low, _, data, offsets in text_chunks(column):
                for row, kinds in _likely(data, offsets).items():
                    text = column[low + row].as_py()
                    found = base_spans(text, tuple(kinds))
                    if "random" in kinds:
                        found += random_spans(text, Efficiency.of(lines.value), found)
                    spans[low + row] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], ["id", "spans"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)
