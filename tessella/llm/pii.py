"""Personal data: exact base patterns, and a character BiLSTM-CRF that adds spans written in other ways.

The model reads every text whole, in overlapping windows. Each window is decoded by Viterbi, unless a bound shows that the
path without any span is its best one, and the windows' spans are reconciled over the whole text: base spans stay, then the
surest span first, none overlapping another. A span that reaches into the last `EDGE` characters of a window which the text
goes beyond gives way to the neighbour window that has it whole; windows overlap by the longest span and both edges.
Added spans must reach a posterior of `SURE` and hold what their kind must hold (`plausible`).

Defined results: a null text counts as empty (no spans). Counts and base_sha256 are of base spans alone. Rows that repeat
come back once each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tagger
from ._common import batches_of, kept, prepare

KINDS = tagger.KINDS
SURE, EDGE = 0.6, 8
#: Characters of texts that a worker tags at once, about.
HELD = 4_000_000
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A local part, an at, a host, a dot and an ending, in any notation.
_EMAIL = re.compile(r"(?i)\w\W*(?:@|\bat\b)\W*\w[^@]*(?:\.|\bdot\b)\W*\w")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the run of local characters before it, then the domain."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if len(m[0]) <= 40 and 13 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def plausible(kind: int, s: str) -> bool:
    """What a span of the kind must hold, however it is written."""
    digits = [*filter("0123456789".__contains__, s)]
    if kind == 0:
        return "\n" not in s and bool(_EMAIL.search(s))
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return s.count(":") > 1 or len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn("".join(digits))
    return 7 <= len(digits) <= 15


def added_spans(model: tagger.Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text the model's spans that overlap no base span."""
    out = []
    for text, own, found in zip(texts, base, model.spans(texts)):
        taken = [(a, b) for _, a, b in own]
        added = []
        whole = {x[:4] for x in found if not (x[2] < x[4] + EDGE and x[4] > 0) and not (x[3] > x[5] - EDGE and x[5] < len(text))}
        for sure, k, a, b in sorted(whole, key=lambda x: (-x[0], x[2], x[3], x[1])):
            if sure < SURE:
                break
            while b > a and text[b - 1].isspace():
                b -= 1
            while a < b and text[a].isspace():
                a += 1
            if any(a < y and x < b for x, y in taken) or not plausible(k, text[a:b]):
                continue
            # A digit or letter right next to it means that a longer run was cut.
            if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
                continue
            taken.append((a, b))
            added.append((k, a, b))
        out.append(added)
    return out


def _held(texts: list[str]) -> Iterator[slice]:
    """Parts of the texts that hold about so many characters each."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= HELD:
            yield slice(at, i + 1)
            at, n = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _spans(model: tagger.Tagger, texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    base = [base_spans(t) for t in texts]
    return base, [x for part in _held(texts) for x in added_spans(model, texts[part], base[part])]


def _model(weights: dict[str, np.ndarray], name: str) -> tagger.Tagger:
    """This worker's model of these weights, with the windows that it remembers."""
    own = kept("pii")
    if own.get("name") != name:
        own.update(name=name, model=tagger.Tagger(weights))
    return own["model"]


def _name(weights: dict[str, np.ndarray]) -> str:
    return hashlib.sha256(b"".join(weights[k].tobytes() for k in sorted(weights))).hexdigest()


def join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the outer parts merge."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per row of docs."""
    prepare(docs.sparkSession)
    weights = weights or tagger.trained()
    shared, name = docs.sparkSession.sparkContext.broadcast(weights), _name(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value, name)
        for b in batches_of(batches):
            texts = [x.as_py() or "" for x in b.column(1)]
            base, more = _spans(model, texts)
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(join(x).encode()).hexdigest() for x in base], pa.string())
            spans = pa.array([join(x + y) for x, y in zip(base, more)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans, pa.array([len(y) for y in more], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """docs with the text of every span replaced by its kind; a null text stays null. Columns and other values stay."""
    prepare(docs.sparkSession)
    weights = weights or tagger.trained()
    shared, name = docs.sparkSession.sparkContext.broadcast(weights), _name(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value, name)
        for b in batches_of(batches):
            texts = [x.as_py() for x in b.column(at)]
            base, more = _spans(model, [t or "" for t in texts])
            new = pa.array([None if t is None else mask(t, x + y) for t, x, y in zip(texts, base, more)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
