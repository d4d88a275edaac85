"""License scans by a positional index of rare words.

Words are maximal runs of 0-9, a-z (after A-Z are lowered) and characters beyond ASCII. Document frequencies of all words
of the templates are counted over all documents. Each template is indexed by its words of the highest IDF (three fifths of
its words, RARE at most), with their positions. In a file every occurrence of an indexed word is looked up; a posting
(template, position q) that meets it at word p says that the template would begin at word p - q. Postings of one template
whose beginnings lie in two neighbouring blocks of SLACK words are one alignment. An alignment whose aligned words have
half of the template's rare IDF weight, and in which all of the template's mandatory phrases begin where they should (in the
same two blocks), is a license of that template's label. Base phrases are found wherever they stand.

The score is the best verified alignment's share of weight, and 0.5 at least where a base phrase stands; else 0.

Templates are a parameter, so the index is as small as they are; documents pass one map without a shuffle, and one row of
counts for each template word and task is shuffled before. A text is read in parts cut between words, two bytes a word stay.

Defined results: a null text counts as empty (no words, no labels, score 0). Repeated rows come back once each. Other columns
are ignored. An empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, prepare

#: Phrases of the contract and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Label, words of a notice, and phrases that must stand in it. Words as the scan cuts them.
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "either version 3 of the license"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "either version 2 of the license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
]
#: Rare words of a template at most; words in a block of beginnings; share of weight that makes an alignment.
RARE, SLACK, ENOUGH = 8, 16, 0.5
#: Bytes of text that are cut into words at once.
PART = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Index(NamedTuple):
    """Word ids, and for each template its rare words (id, position, weight) and mandatory phrases (ids, position)."""

    ids: dict[bytes, int]
    labels: list[str]
    rare: list[list[tuple[int, int, float]]]
    musts: list[list[tuple[tuple[int, ...], int]]]
    base: list[tuple[tuple[int, ...], str]]


def word_ids(templates=TEMPLATES) -> dict[bytes, int]:
    """Ids of all words of the templates and base phrases."""
    texts = [t[1] for t in templates] + [p for t in templates for p in t[2]] + [p for p, _ in BASE]
    return {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t.encode().split()))}


def words_of(text: str | None, ids: dict[bytes, int]) -> np.ndarray:
    """Each word's id, -1 for words of no template."""
    raw, at, got = (text or "").encode("utf-8").lower(), 0, []  # bytes.lower changes A-Z only
    while at < len(raw):
        end = min(at + PART, len(raw))
        while end < len(raw) and WORD.match(raw, end):  # not within a word
            end = WORD.match(raw, end).end()
        got.append(np.fromiter((ids.get(w, -1) for w in WORD.findall(raw[at:end])), np.int16))
        at = end
    return np.concatenate(got) if got else np.zeros(0, np.int16)


def places(x: np.ndarray, phrase: tuple[int, ...]) -> np.ndarray:
    """Where the words of phrase stand consecutively."""
    n = len(x) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(x[:n] == phrase[0])
    for k, w in enumerate(phrase[1:], 1):
        at = at[x[at + k] == w]
    return at


def frequencies(docs: DataFrame, ids: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """How many documents there are, and how many have each word of ids; summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(ids) + 1, np.int64), 0
        for b in batches_of(batches):
            for x in b.column(0):
                df[np.unique(words_of(x.as_py(), ids))] += 1  # -1 is the last place
                n += 1
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df)), pa.int32()), pa.array(df)], ["id", "n"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    got = {r["id"]: r["n"] for r in rows}  # one row a template word
    return got.pop(len(ids), 0), got


def build(n: int, df: dict[int, int], templates=TEMPLATES) -> Index:
    """The positional index of each template's rarest words; equally rare ones in order of position."""
    ids = word_ids(templates)
    rare, musts = [], []
    for _, text, phrases in templates:
        words = [ids[w] for w in text.encode().split()]
        most = min(RARE, -(-len(words) * 3 // 5))
        chosen = sorted(range(len(words)), key=lambda q: (df.get(words[q], 0), q))[:most]
        rare.append([(words[q], q, 1.0 + math.log((1 + n) / (1 + df.get(words[q], 0)))) for q in chosen])
        coded = [tuple(ids[w] for w in p.encode().split()) for p in phrases]
        musts.append([(p, next(q for q in range(len(words)) if tuple(words[q : q + len(p)]) == p)) for p in coded])
    return Index(ids, [t[0] for t in templates], rare, musts, [(tuple(ids[w] for w in p.encode().split()), label) for p, label in BASE])


def verified(x: np.ndarray, index: Index) -> dict[int, float]:
    """Templates that some alignment verifies, each with the best share of weight."""
    where: dict[int, np.ndarray] = {}

    def of(w: int) -> np.ndarray:
        if w not in where:
            where[w] = np.flatnonzero(x == w)
        return where[w]

    known, out = np.zeros(len(index.ids) + 1, bool), {}
    known[x] = True
    for t, rare in enumerate(index.rare):
        total = sum(r[2] for r in rare)
        if round(sum(r[2] for r in rare if known[r[0]]) / total, 9) < ENOUGH or not all(known[w] for p, _ in index.musts[t] for w in p):
            continue
        spots = [np.unique((of(w) - q) // SLACK) for w, q, _ in rare]
        begins = np.unique(np.concatenate(spots))
        share = np.zeros(len(begins))
        for (_, _, weight), s in zip(rare, spots):  # the block itself or the next one
            share += weight * (np.isin(begins, s) | np.isin(begins + 1, s))
        share = np.round(share / total, 9)
        good = share >= ENOUGH
        for p, q in index.musts[t]:
            if good.any():
                s = np.unique((places(x, p) - q) // SLACK)
                good &= np.isin(begins, s) | np.isin(begins + 1, s)
        if good.any():
            out[t] = float(share[good].max())
    return out


def judge(text: str | None, index: Index) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    x = words_of(text, index.ids)
    found = [(places(x, p), label) for p, label in index.base]
    starts = np.concatenate([at for at, _ in found])
    base = sorted({label for at, label in found if len(at)})
    own = verified(x, index)
    score = round(max([0.5 if base else 0.0, *own.values()]), 6)
    labels = sorted({*base, *(index.labels[t] for t in own)})
    ends = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
    return len(x), len(starts), *ends, ",".join(base), ",".join(labels), score


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of docs."""
    index = build(*frequencies(docs, word_ids(templates)), templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            rows = [judge(x.as_py(), index) for x in b.column(1)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TEXTS = _values([(t, label, text) for t, (label, text, _) in enumerate(TEMPLATES)])
_MUSTS = _values([(t, k, p, next(q for q in range(len(text.split())) if text.split()[q : q + len(p.split())] == p.split())) for t, (_, text, phrases) in enumerate(TEMPLATES) for k, p in enumerate(phrases)])
#: The same scan over a table of words. Phrases are found by comparing lists of words that follow one another.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS MATERIALIZED (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d
), base(phrase, label) AS (VALUES {_values(BASE)}
), hit AS (SELECT w.rid, w.p, label FROM base JOIN w ON w.w = split_part(phrase, ' ', 1) JOIN d ON d.rid = w.rid AND ws[p + 1 : p + len(string_split(phrase, ' '))] = string_split(phrase, ' ')
), b AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hit GROUP BY rid
), tpl(t, label, txt) AS (VALUES {_TEXTS}
), tw AS (SELECT t, unnest(string_split(txt, ' ')) AS w, unnest(range(len(string_split(txt, ' ')))) AS q, least({RARE}, CAST(ceil(len(string_split(txt, ' ')) * 3 / 5) AS INT)) AS most FROM tpl
), df AS (SELECT w, count(DISTINCT rid) AS df FROM w WHERE w IN (SELECT w FROM tw) GROUP BY w
), rare AS (SELECT t, w, q, 1.0 + ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + coalesce(df, 0))) AS weight FROM tw LEFT JOIN df USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), q) <= most
), total AS (SELECT t, sum(weight) AS total FROM rare GROUP BY t
), spot AS (SELECT DISTINCT rid, t, q, weight, CAST(floor((p - q) / {SLACK}) AS BIGINT) AS s FROM w JOIN rare USING (w)
), open AS (SELECT DISTINCT rid, t, s FROM spot
), al AS (SELECT o.rid, o.t, o.s, round(sum(weight) / any_value(total), 9) AS share FROM open o JOIN (SELECT rid, t, q, weight, s FROM spot UNION SELECT rid, t, q, weight, s - 1 FROM spot) x USING (rid, t, s) JOIN total USING (t) GROUP BY ALL HAVING share >= {ENOUGH}
), must(t, k, phrase, q) AS (VALUES {_MUSTS}
), mp AS (SELECT DISTINCT w.rid, t, k, CAST(floor((w.p - q) / {SLACK}) AS BIGINT) AS s FROM must JOIN w ON w.w = split_part(phrase, ' ', 1) JOIN d ON d.rid = w.rid AND ws[p + 1 : p + len(string_split(phrase, ' '))] = string_split(phrase, ' ')
), ok AS (SELECT al.rid, al.t, al.s, al.share FROM al JOIN (SELECT rid, t, k, s FROM mp UNION SELECT rid, t, k, s - 1 FROM mp) x USING (rid, t, s) JOIN (SELECT t, count(*) AS need FROM must GROUP BY t) USING (t) GROUP BY al.rid, al.t, al.s, al.share HAVING count(DISTINCT k) = any_value(need)
), every AS (SELECT rid, label, CAST(0.5 AS DOUBLE) AS share FROM hit UNION ALL SELECT rid, label, share FROM ok JOIN tpl USING (t)
), l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM every GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)"""
