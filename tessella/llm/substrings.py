"""Substring deduplication by hashing of lines or paragraphs, and of word runs.

`repeated_units` hashes lines or paragraphs: normalised (lower-cased, white space of ASCII made one space, none at the
ends), digests grouped over all rows, the earliest by (doc_id, row, place) kept and every later copy listed with its
offsets in the original text, its line break included. Blank units are none. Digests are aggregated before they are
shuffled, and the rows of a digest that fills more than a task's share meet its first place by a bounded broadcast.

Passages that start or end inside a line need more. `repeated_passages` hashes runs of words. A text's words are lower-cased and split at white space, so a passage is measured in words wherever it starts and ends. A
run of `least_words` words that occurs before, by (doc_id, row, place), is a repeat; the words that repeats cover are
removed, as passages with their offsets in the original text and the place of the copy that stays. So each passage of at
least that many words is found whole, to the word, and shorter repeats are left to the units. `without_repeats` removes
either or both. A copy points to an earlier place, so of all that goes an equal stretch stays somewhere.

Not every run is compared. Winnowing picks a print, the least hash of the half-length runs in each run; equal runs pick
equal prints. The runs of one print in a row form a block. Runs whose print is unique in the corpus are unique; where all
blocks of a print are equal a block is compared as a whole; only the others (at passages' ends) are compared run by run.

Digests and numbers are compared, of 128 bits each; text moves once, to the places of its row's repeated prints. Digests
are aggregated before they are shuffled and the join back is one that Spark can split.

Defined results: a text of fewer words, null or blank, has no runs, and a null or blank text no units. Very long texts
are cut whole. A text that repeats itself keeps its first copy. Rows
that share a doc_id and text are copies of one another: the one with the lower row number ranks first, and the other's
passages are removed. A null doc_id ranks after all others. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import batches_of, discard, joined_by, prepare, settle, table

LEAST_WORDS = 40
#: Words whose hashes a worker remembers, and rows in one batch that it returns.
WORDS, ROWS = 500_000, 50_000
#: What ends a unit: a line break, or line breaks with nothing but blanks between.
LINE, PARAGRAPH = r"\n", r"\n(?:[\x20\x09-\x0D]*\n)+"
_WORD, _BLANK = re.compile(r"\S+"), re.compile(r"[\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
_KNOWN: dict[str, int] = {}


def hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    words = text.lower().split()
    found = [*map(_KNOWN.get, words)]
    if None in found:
        if len(_KNOWN) > WORDS:
            _KNOWN.clear()
        for i, x in enumerate(found):
            if x is None:
                found[i] = _KNOWN[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.fromiter(found, np.uint64, len(found))


def blocks(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first run, number of runs, print) of each block; a run is numbered by its first word."""
    short = max(1, least // 2)
    if len(words) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.zeros(len(words) - short + 1, np.uint64)
    for i in range(short):
        x = x * np.uint64(_BASE) + words[i : i + len(x)]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    span = least - short + 1
    pick = np.lib.stride_tricks.sliding_window_view(x, span).argmin(axis=1) + np.arange(len(x) - span + 1)
    first = np.flatnonzero(np.diff(pick, prepend=-1))
    return first, np.diff(first, append=len(pick)), x[pick[first]].view(np.int64)


def prints(docs: DataFrame, least: int) -> DataFrame:
    """(rid, at, n, f, h): every block of every row, with its print and a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_digest
        for b in batches_of(batches):
            parts, held = [], 0
            for r, x in zip(b.column(0).to_pylist(), b.column(1)):
                words = hashes(x.as_py() or "")
                at, n, f = blocks(words, least)
                if len(at):
                    raw = memoryview(words).cast("B")
                    h = np.frombuffer(b"".join([digest(raw[8 * i : 8 * j]) for i, j in zip(at.tolist(), (at + n + least - 1).tolist())]), ">i8").astype(np.int64)
                    parts.append((np.full(len(at), r), at.astype(np.int32), n.astype(np.int32), f, h))
                    held += len(at)
                if held >= ROWS:
                    yield pack(parts)
                    parts, held = [], 0
            if parts:
                yield pack(parts)

    def pack(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["rid", "at", "n", "f", "h"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, at int, n int, f long, h long")


def occurrences(places: DataFrame, least: int) -> DataFrame:
    """(rid, doc_id, at, n, start, stop, h, g): the runs of places (rid, doc_id, text, p) to be compared; n of them from
    `at` on are one. h and g are the halves of the digest of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches_of(batches):
            parts, digests = [], []
            for r, d, x, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                text = x.as_py()
                raw = memoryview(hashes(text)).cast("B")
                ends = np.array([m.span() for m in _WORD.finditer(text)], np.int32)
                at, n, whole = (p.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "n", "whole"))
                each = np.where(whole, 1, n)
                i = np.repeat(at - np.cumsum(each) + each, each) + np.arange(each.sum())
                held = np.repeat(np.where(whole, n, 1), each)
                j = i + held + least - 1
                parts.append((np.full(len(i), r), np.full(len(i), d or 0), np.full(len(i), d is None), i.astype(np.int32), held.astype(np.int32), ends[i, 0], ends[j - 1, 1]))
                digests += [digest(raw[x:y]) for x, y in zip((8 * i).tolist(), (8 * j).tolist())]
                if len(digests) >= ROWS:
                    yield pack(parts, digests)
                    parts, digests = [], []
            if parts:
                yield pack(parts, digests)

    def pack(parts: list[tuple[np.ndarray, ...]], digests: list[bytes]) -> pa.RecordBatch:
        rid, doc, none, *cols = (np.concatenate(c) for c in zip(*parts))
        halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(doc, mask=none), *map(pa.array, cols), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["rid", "doc_id", "at", "n", "start", "stop", "h", "g"])

    return places.select("rid", "doc_id", "text", "p").mapInArrow(run, "rid long, doc_id long, at int, n int, start int, stop int, h long, g long")


def cut(text: str, ends: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """(start, stop, normalised unit) of each unit that is not blank; stop is past what ends the unit."""
    at = 0
    for end, stop in [*((m.start(), m.end()) for m in ends.finditer(text)), (len(text), len(text))]:
        if unit := _BLANK.sub(" ", text[at:end].lower()).strip(" "):
            yield at, stop, unit
        at = stop


def units(docs: DataFrame, mark: str) -> DataFrame:
    """(rid, doc_id, start, stop, h, g): every unit of every row; h and g are the halves of its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, ends, rows, digests = xxhash.xxh3_128_digest, re.compile(mark), [], []
        for b in batches_of(batches):
            for r, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for start, stop, unit in cut(x.as_py() or "", ends):
                    rows.append((r, d, start, stop))
                    digests.append(digest(unit.encode("utf-8")))
                    if len(rows) >= ROWS:
                        yield pack(rows, digests)
                        rows, digests = [], []
        if rows:
            yield pack(rows, digests)

    def pack(rows: list[tuple], digests: list[bytes]) -> pa.RecordBatch:
        r, d, start, stop = zip(*rows)
        halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(d, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["rid", "doc_id", "start", "stop", "h", "g"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, start int, stop int, h long, g long")


def repeated_units(docs: DataFrame, mark: str = LINE) -> DataFrame:
    """(doc_id, start, stop, keep_doc_id, keep_start, keep_stop): every later copy of a unit, and its first.

    start and stop are code points of the original text, stop exclusive and past the unit's end mark.
    """
    return _repeated_units(_numbered(docs), mark).drop("rid")


def _repeated_units(docs: DataFrame, mark: str) -> DataFrame:
    """repeated_units() of docs (rid, doc_id, text), with rid."""
    prepare(docs.sparkSession)
    found = table(units(docs, mark), "units")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "start", "stop")
    first = table(found.groupBy("h", "g").agg(F.min(order).alias("first"), F.count("*").alias("rows")).filter("rows > 1"), "repeated-units")
    settle(docs.sparkSession)
    again = joined_by(found, first, "h", "g").filter((F.col("first.rid") != F.col("rid")) | (F.col("first.start") != F.col("start")))
    return again.select("rid", "doc_id", "start", "stop", *[F.col(f"first.{c}").alias(f"keep_{c}") for c in ("doc_id", "start", "stop")])


#: repeated_units() of documents by lines.
SQL = r"""
WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
spans AS (SELECT doc_id, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
  CAST(least(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), length(text)) AS INTEGER) AS stop,
  trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS unit FROM lines),
ranked AS (SELECT doc_id, start, stop, row_number() OVER w AS n, first_value(doc_id) OVER w AS keep_doc_id, first_value(start) OVER w AS keep_start, first_value(stop) OVER w AS keep_stop
  FROM spans WHERE unit <> '' WINDOW w AS (PARTITION BY unit ORDER BY doc_id NULLS LAST, start))
SELECT doc_id, start, stop, keep_doc_id, keep_start, keep_stop FROM ranked WHERE n > 1
"""


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, stop, words, keep_doc_id, keep_start, keep_stop): passages to remove.

    start and stop are code points of the original text, stop exclusive; keep_* is the first occurrence of the passage's
    first run (keep_start) and the end of the first occurrence of its last run (keep_stop, null if that is in another
    document).
    """
    return _passages(_numbered(docs), least_words).drop("rid")


def _passages(docs: DataFrame, least_words: int) -> DataFrame:
    """repeated_passages() of docs (rid, doc_id, text), with rid."""
    prepare(docs.sparkSession)
    found = table(prints(docs, least_words), "prints")
    shared = table(found.groupBy("f").agg(F.count("*").alias("c"), (F.min("h") == F.max("h")).alias("whole")).filter("c > 1").drop("c"), "shared-prints")
    settle(docs.sparkSession)
    p = found.join(shared, "f").groupBy("rid").agg(F.collect_list(F.struct("at", "n", "whole")).alias("p"))
    places = table(docs.join(p, "rid"), "repeated-prints")
    # What follows reads the places alone, so the prints and the shuffles behind them need not stay on disk.
    discard(found, shared)
    settle(docs.sparkSession)
    occ = occurrences(places, least_words)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "at", "start", "stop")
    first = table(occ.groupBy("h", "g").agg(F.min(order).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"), "repeated-runs")
    settle(docs.sparkSession)
    again = occ.join(first, ["h", "g"]).filter((F.col("first.rid") != F.col("rid")) | (F.col("first.at") != F.col("at")))
    again = again.select("rid", "doc_id", "at", (F.col("at") + F.col("n") + least_words - 1).alias("to"), "start", "stop", F.col("first.doc_id").alias("kd"), F.col("first.start").alias("ks"), F.col("first.stop").alias("ke"))
    # A passage ends where the next repeat of its row starts after the last one's end.
    own = Window.partitionBy("rid").orderBy("at")
    passages = again.withColumn("new", F.coalesce((F.col("at") > F.lag("to").over(own)).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(own))
    at = F.struct("at", "kd", "ks", "ke")
    runs = passages.groupBy("rid", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("to") - F.min("at")).cast("long").alias("words"), F.min(at).alias("a"), F.max(at).alias("z"))
    return runs.select("rid", "doc_id", "start", "stop", "words", F.col("a.kd").alias("keep_doc_id"), F.col("a.ks").alias("keep_start"), F.when(F.col("a.kd").eqNullSafe(F.col("z.kd")), F.col("z.ke")).alias("keep_stop"))


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (start, stop), which do not overlap."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _merged(spans: DataFrame) -> DataFrame:
    """spans (rid, start, stop) with those that overlap or touch made one."""
    own = Window.partitionBy("rid").orderBy("start", "stop")
    before = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    cuts = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(0)))
    runs = cuts.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, mark: str | None = None) -> DataFrame:
    """docs, every row of it, with the repeated passages taken out of text, with a mark the repeated units too, and removed:
    their (start, stop) in the original text, in order, overlapping ones as one. A null text stays null. Where docs has a
    column of that name, underscores are added to the new one's."""
    have = {c.lower() for c in docs.columns}
    rid, removed = (next(n for n in (name + "_" * i for i in range(len(have) + 1)) if n not in have) for name in ("rid", "removed"))
    # Written once, so a row's number is the same wherever it is read.
    rows = table(docs.select(F.monotonically_increasing_id().alias(rid), "*"), "numbered")
    texts = rows.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _passages(texts, least_words)
    if mark is not None:
        span = ["rid", "start", "stop"]
        found = _merged(found.select(span).union(_repeated_units(texts, mark).select(span)))
    spans = found.groupBy(F.col("rid").alias(rid)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(removed))

    @F.pandas_udf("string")
    def cleaned(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, start, stop in parts:
            yield pd.Series([remove(t, [*zip(a.tolist(), b.tolist())]) for t, a, b in zip(text, start, stop)], dtype=object)

    both = rows.join(spans, rid, "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    # The spans' rows alone pass through Python; the others' texts stay as they are.
    hit, rest = both.filter(F.col(removed).isNotNull()), both.filter(F.col(removed).isNull())
    out = hit.withColumn("text", cleaned("text", f"{removed}.start", f"{removed}.stop")).unionByName(rest.withColumn(removed, none))
    return out.select(*docs.columns, removed)
