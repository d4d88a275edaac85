"""Language identification, word first with backoff to character n-grams.

A word the model has seen scores its smoothed log frequency in each language. An unseen word falls back to its character
n-grams (with word edges), from the longest length to the shortest, and takes the mean log frequency of the n-grams of
the first length at which any is known. A text's language has the highest sum over its words.

Learning uses rows with a text, a lang and a fold other than 0, about `most_rows` of each language, chosen by a hash of
doc_id, so a rare language is learned however large the corpus is. All their words are known, and n-gram tables are made
of them. So the sample's bound bounds the model, which each worker holds.

Defined results: null text or one without a letter gives `und`, score 0; any other text gets a language, if there is
something to learn from. Every word of a text counts, however long the text. Ties go to the language that sorts first, with an equal share as score if no n-gram is known. Rows that repeat come back once each. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, fold, kept, prepare

#: Rows of each language that are learned from, about; the longest n-gram.
MOST_ROWS, LONGEST = 500, 5
#: Words of evidence at which the score stops growing.
EVIDENCE = 12
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


class Model:
    """Log frequencies by language of words and of n-grams of each length: rows of one matrix."""

    def __init__(self, langs: list[str], rows: np.ndarray, words: dict[str, int], grams: list[dict[str, int]]):
        self.langs, self.rows, self.words, self.grams = langs, rows, words, grams

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]], longest: int = LONGEST) -> Model:
        """counts: (lang, word, n)."""
        langs = sorted({x[0] for x in counts})
        if not langs:
            return cls([], np.zeros((0, 0)), {}, [])
        at = {x: i for i, x in enumerate(langs)}
        tables: list[dict[str, list[float]]] = [{} for _ in range(longest + 1)]

        def add(table: dict[str, list[float]], key: str, lang: int, x: float) -> None:
            if key not in table:
                table[key] = [0.0] * len(langs)
            table[key][lang] += x

        for lang, word, n in counts:
            add(tables[0], word, at[lang], n)
            edged, weight = f" {word} ", math.sqrt(n)
            for k in range(1, longest + 1):
                for i in range(len(edged) - k + 1):
                    add(tables[k], edged[i : i + k], at[lang], weight)
        rows, places, first = [], [], 0
        for t in tables:
            x = np.array(list(t.values()), np.float64).reshape(-1, len(langs))
            # Exact sums, so equal counts in equal tables tie.
            rows.append(np.log((x + 0.1) / (np.array([math.fsum(c) for c in x.T]) + 0.1 * len(t))))
            places.append({key: first + i for i, key in enumerate(t)})
            first += len(t)
        return cls(langs, np.concatenate(rows), places[0], places[1:])

    def backoff(self, word: str) -> list[int]:
        """Rows of the known n-grams of the longest length at which the word has any."""
        edged = f" {word} "
        for k in range(min(len(self.grams), len(edged)), 0, -1):
            g = self.grams[k - 1]
            if found := [x for i in range(len(edged) - k + 1) if (x := g.get(edged[i : i + k])) is not None]:
                return found
        return []

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not words or not self.langs:
            return UNKNOWN, 0.0
        found = [*map(self.words.get, words)]
        places = [x for x in found if x is not None]
        n = len(places)
        total = self.rows[places].sum(axis=0) if n else np.zeros(len(self.langs))
        if n < len(words):
            far, weights, letters = [], [], n > 0
            for w, x in zip(words, found):
                if x is None:
                    # Numerals such as a superscript count as word characters, but are no letters.
                    for part in (w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split():
                        letters = True
                        if grams := self.backoff(part):
                            far += grams
                            weights += [1 / len(grams)] * len(grams)
                            n += 1
            if not letters:
                return UNKNOWN, 0.0
            if far:
                total = total + np.array(weights) @ self.rows[far]
        if not n:
            return self.langs[0], 1 / len(self.langs)
        best = int(np.argmax(total))
        mean = (total - total[best]) / n
        return self.langs[best], float(1 / np.exp(mean * min(n, EVIDENCE)).sum())


def fit(docs: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    rows = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").filter(fold() != 0)
    scale = 1 << 30
    # One row a language, of which the model holds a column each.
    rates = rows.groupBy("lang").agg(F.least(F.lit(scale), F.ceil(F.lit(float(scale * most_rows)) / F.count("*"))).cast("long").alias("rate"))
    chosen = rows.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.col("rate"))
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return Model.fit(sorted((r["lang"], r["word"], r["n"]) for r in counts.toLocalIterator()))


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs."""
    prepare(docs.sparkSession)
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.rows, model.words, model.grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language")
        own = Model(*shared.value)
        for b in batches_of(batches):
            got = [own.predict(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), (fold() == 0).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose predicted language is not `und`, with all their columns."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.rows, model.words, model.grams))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language")
        own = Model(*shared.value)
        for b in batches_of(batches):
            yield b.filter(pa.array([own.predict(x.as_py())[0] != UNKNOWN for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
