"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found through a block-max inverted index.

Terms are words and their prefixes of four to six letters, all of them that the examples have. A term that tells the
labels of the examples apart (a one-sided likelihood-ratio test, Bonferroni-corrected over all terms) weighs `TELLING`
times as much. Examples are laid out in blocks; each term has its postings and the largest weight in each block that has
any. A query bounds every block by the sum of its terms' block maxima and visits the blocks of the highest bounds first and
then all that can still hold one of its k best cosines, so the nearest neighbours are exact. They vote by their
closeness; the vote is calibrated by isotonic regression on the examples, each scored without itself. A text without any
term of the examples takes the rate of toxic labels.

Learning uses labels of rows with a fold other than 0, at most about `most_rows` of each label, chosen by a hash of
doc_id. A document with contradictory labels counts as toxic.

Defined results: a null or empty text has no term. With no examples every score is 0. Equal texts get equal scores. Rows
that repeat come back once each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, bounded_sample, fold, prepare

MOST_ROWS, NEAREST, BLOCK, TELLING = 1500, 24, 128, 4
#: Texts whose scores, and words whose terms, a worker remembers; texts searched together.
CACHE, WORDS, TOGETHER = 50_000, 300_000, 128
#: Common terms held in full, at most.
COMMON = 1536
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Counts of words and word prefixes (with a trailing mark)."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        out[w] += n
        for k in (4, 5, 6):
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


class Index:
    """Examples' unit TF-IDF vectors: postings by term and block, with the block's largest weight."""

    def __init__(self, vocabulary: dict[str, tuple[int, float]], vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], empty_rate: float, ids: list[int] | None = None, block: int = BLOCK):
        self.vocabulary, self.labels, self.block, self.empty_rate = vocabulary, np.array(labels, np.int8), block, empty_rate
        self.ids = ids if ids is not None else list(range(len(vectors)))
        lengths = np.array([len(at) for at, _ in vectors], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in vectors)]).astype(np.int32), np.concatenate([np.zeros(0), *(q for _, q in vectors)]), lengths
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self._lay_out()

    def __getstate__(self) -> dict:
        """Only what the layout is made from travels: the examples' terms and weights."""
        return {k: self.__dict__[k] for k in ("vocabulary", "labels", "block", "empty_rate", "ids", "flat", "steps")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lay_out()

    def _lay_out(self) -> None:
        vocabulary, block = self.vocabulary, self.block
        self.idf = np.array([x[1] for x in vocabulary.values()])
        term, weight, lengths = self.flat
        self.size = len(lengths)
        term, place = term.astype(np.int64), np.repeat(np.arange(self.size), lengths)
        # The most common terms, which would fill nearly every block, have their weights in full.
        counts = np.bincount(term, minlength=len(vocabulary))
        often = np.sort(np.argsort(-counts, kind="stable")[:COMMON])
        often = often[counts[often] * 64 > self.size]
        self.row = np.full(len(vocabulary), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.blocks = -(-self.size // block)
        self.often = np.zeros((len(often), self.blocks * block))
        held = self.row[term] >= 0
        self.often[self.row[term[held]], place[held]] = weight[held]
        # Postings of the others, by term and place; where each block of each term begins, and its largest weight.
        term, place, weight = term[~held], place[~held], weight[~held]
        order = np.lexsort((place, term))
        term, self.place, self.weight = term[order], place[order].astype(np.int32), weight[order]
        part = term * self.blocks + self.place // block
        self.begin = np.searchsorted(part, np.arange(len(vocabulary) * self.blocks + 1)).astype(np.int32)
        self.maxima = np.zeros(len(vocabulary) * self.blocks, np.float32)
        np.maximum.at(self.maxima, part, np.nextafter(self.weight.astype(np.float32), np.float32(2)))
        self.maxima = self.maxima.reshape(len(vocabulary), self.blocks)
        self.cache: dict[bytes, tuple[float, str]] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    @cached_property
    def dense(self) -> np.ndarray:
        """All weights by term and place, for tests."""
        out = np.zeros((len(self.vocabulary), self.size))
        for t in range(len(self.vocabulary)):
            if self.row[t] >= 0:
                out[t] = self.often[self.row[t], : self.size]
            else:
                i = slice(self.begin[t * self.blocks], self.begin[(t + 1) * self.blocks])
                out[t, self.place[i]] = self.weight[i]
        return out

    def _terms(self, token: str) -> tuple[int, ...]:
        """The terms of a run of characters without white space, in the index's vocabulary."""
        get, out = self.vocabulary.get, []
        for w in (token,) if token.isalpha() else _WORD.findall(token):
            if (x := get(w)) is not None:
                out.append(x[0])
            for k in (4, 5, 6):
                # A word with a longer prefix has the shorter ones too.
                if len(w) <= k or (x := get(w[:k] + "*")) is None:
                    break
                out.append(x[0])
        return tuple(out)

    def arrays(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of the text's unit TF-IDF vector, as they first occur, and their weights."""
        tokens = Counter((text or "").lower().split())
        rows = [*map(self.known.get, tokens)]
        if None in rows:
            known = self.known
            if len(known) > WORDS:
                known.clear()
            for i, (w, x) in enumerate(zip(tokens, rows)):
                if x is None:
                    rows[i] = self._terms(w)
                    if len(w) <= 64:
                        known[w] = rows[i]
        found: dict[int, int] = {}
        get = found.get
        for row, n in zip(rows, tokens.values()):
            for t in row:
                found[t] = get(t, 0) + n
        at, n = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))
        q = (1 + np.log(n)) * self.idf[at]
        return at, q / np.sqrt(q @ q) if len(q) else q

    def vector(self, text: str | None) -> dict[int, float]:
        """The text's unit TF-IDF vector over the index's terms."""
        at, q = self.arrays(text)
        return dict(zip(at.tolist(), q.tolist()))

    def nearest(self, query: dict[int, float], k: int = NEAREST) -> list[tuple[float, int]]:
        """The k examples of the highest cosine above 0, exactly; ties to the lower place."""
        return self.search([(np.fromiter(query, np.int64), np.fromiter(query.values(), np.float64))], k)[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST, without: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights) its nearest examples; without: a place for each query that is left out."""
        if not self.size:
            return [[] for _ in queries]
        many = np.arange(len(queries))
        s, rare = np.zeros((len(queries), len(self.often))), []
        for i, (at, q) in enumerate(queries):
            row = self.row[at]
            common = row >= 0
            s[i, row[common]] = q[common]
            rare.append((at[~common], q[~common]))
        s = s @ self.often
        bound = s.reshape(len(queries), self.blocks, self.block).max(axis=2)
        # Single precision, rounded up: a bound may only be too high.
        bound += np.stack([q.astype(np.float32) @ self.maxima[at] for at, q in rare]) * (1 + 1e-4)
        chosen = np.zeros(bound.shape, bool)
        chosen[many[:, None], np.argsort(-bound, axis=1, kind="stable")[:, : max(1, -(-2 * k // self.block))]] = True
        begun = s
        for last in (False, True):
            s = np.stack([self._add(own, at, q, pick) for own, (at, q), pick in zip(begun, rare, chosen)])
            if without is not None:
                s[many, without] = -1
            # What blocks not visited have so far counts as well: it can only grow.
            least = np.maximum(np.partition(s, -k, axis=1)[:, -k], 0) if k <= s.shape[1] else np.zeros(len(queries))
            if not last:
                chosen |= (bound > 0) & (bound * (1 + 1e-9) >= least[:, None])
        out = []
        for own, low in zip(s, least):
            found = np.flatnonzero((own >= low) & (own > 0))
            out.append([(float(own[i]), int(i)) for i in found[np.argsort(-own[found], kind="stable")][:k]])
        return out

    def _add(self, own: np.ndarray, at: np.ndarray, q: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """A query's cosines by place, with what the postings of its chosen blocks hold. Blocks side by side are one stretch
        of a term's postings; one query at a time, so that what is worked on stays in the processor's cache."""
        edges = np.flatnonzero(np.diff(chosen, prepend=False, append=False))
        part = at[:, None] * self.blocks
        lo = self.begin[part + edges[::2]].ravel()
        n = self.begin[part + edges[1::2]].ravel() - lo
        i = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return own + np.bincount(self.place[i], np.repeat(np.repeat(q, len(edges) // 2), n) * self.weight[i], len(own))

    def vote(self, near: list[tuple[float, int]]) -> float:
        weight = [1 / (1.05 - min(1.0, s)) ** 2 for s, _ in near]
        return sum(w * self.labels[i] for w, (_, i) in zip(weight, near)) / sum(weight)

    def score(self, text: str | None) -> tuple[float, str]:
        """The calibrated score and the evidence: up to three nearest examples as doc_id:label:cosine."""
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """score of each text; equal texts are searched once, others in groups of TOGETHER."""
        keys = [hashlib.blake2b((x or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts]
        if len(self.cache) + len(texts) > CACHE:
            self.cache.clear()
        new = [*{k: x for k, x in zip(keys, texts) if k not in self.cache}.items()]
        for a in range(0, len(new), TOGETHER):
            part = new[a : a + TOGETHER]
            for (k, _), near in zip(part, self.search([self.arrays(x) for _, x in part])):
                score = float(np.interp(self.vote(near), *self.steps)) if near else self.empty_rate
                self.cache[k] = score, ",".join(f"{self.ids[i]}:{self.labels[i]}:{s:.3f}" for s, i in near[:3])
        return [self.cache[k] for k in keys]

    @classmethod
    def fit(cls, texts: list[str | None], labels: list[int], rates: tuple[int, int] | None = None, ids: list[int] | None = None) -> Index:
        """rates: how many rows of label 0 and 1 the examples stand for."""
        df: list[Counter] = [Counter(), Counter()]
        for t, y in zip(texts, labels):
            df[y].update(terms(t).keys())
        n = [max(1, labels.count(0)), max(1, labels.count(1))]
        telling: set[str] = set()
        least = 2 * np.log(20 * max(1, len(df[1])))
        for t, a in df[1].items():
            b = df[0][t]
            p1, p0, p = a / n[1], b / n[0], (a + b) / (n[0] + n[1])
            if p1 > p0 and _gain(a, n[1], p1, p) + _gain(b, n[0], p0, p) > least:
                telling.add(t)
        total = len(labels)
        idf = lambda t: float(np.log((1 + total) / (1 + df[0][t] + df[1][t])) + 1)
        vocabulary = {t: (i, idf(t) * (TELLING if t in telling else 1)) for i, t in enumerate(sorted(df[0].keys() | df[1].keys()))}
        index = cls(vocabulary, [], [], 0.0)
        vectors = [index.arrays(t) for t in texts]
        index.known.clear()
        share = [(rates[y] if rates else n[y]) / n[y] for y in (0, 1)]
        every = [share[y] * labels.count(y) for y in (0, 1)]
        rate = every[1] / sum(every) if sum(every) else 0.0
        # Alike examples side by side: by the heaviest telling term, then the most common one, which tells the language.
        tells = np.array([t in telling for t in vocabulary], bool)
        heavy = [int(at[np.where(tells[at], q, 0).argmax()]) if tells[at].any() else -1 for at, q in vectors]
        order = sorted((i for i, v in enumerate(vectors) if len(v[0])), key=lambda i: (heavy[i], int(vectors[i][0][index.idf[vectors[i][0]].argmin()]), i))
        out = cls(vocabulary, [vectors[i] for i in order], [labels[i] for i in order], rate, [ids[i] if ids else i for i in order])
        found = [near for a in range(0, len(order), TOGETHER) for near in out.search([vectors[i] for i in order[a : a + TOGETHER]], without=np.arange(a, min(a + TOGETHER, len(order))))]
        votes = [(out.vote(near) if near else rate, labels[i], share[labels[i]]) for near, i in zip(found, order)]
        out.steps = isotonic(votes)
        return out


def _gain(k: int, n: int, p: float, q: float) -> float:
    """Twice the log-likelihood ratio of k of n under p against q."""
    out = 0.0
    if k:
        out += 2 * k * np.log(p / q)
    if n - k:
        out += 2 * (n - k) * np.log((1 - p) / (1 - q))
    return float(out)


def isotonic(rows: list[tuple[float, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of label on vote, by pooling adjacent violators; a weak pull to the vote itself."""
    if not rows:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    pools: list[list[float]] = []
    for x, y, w in [(k / 10, k / 10, 0.5) for k in range(11)] + list(rows):
        pools.append([x, y, w])
    pools.sort()
    out: list[list[float]] = []
    for x, y, w in pools:
        out.append([x * w, y * w, w])
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            a = out.pop()
            out[-1] = [p + q for p, q in zip(out[-1], a)]
    return np.array([x / w for x, _, w in out]), np.array([min(1.0, max(0.0, y / w)) for _, y, w in out])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Index:
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).filter(fold() != 0)
    rates = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [bounded_sample(known.filter(F.col("y") == y), "doc_id", most_rows) for y in (0, 1)]
    # Few ids (at most about twice most_rows), so the join may broadcast them.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").dropDuplicates(["doc_id", "text"])
    got = sorted((r["doc_id"], r["y"], r["text"] or "") for r in rows.toLocalIterator())
    return Index.fit([x[2] for x in got], [x[1] for x in got], (rates.get(0, 0), rates.get(1, 0)), [x[0] for x in got])


def toxicity(docs: DataFrame, labels: DataFrame, index: Index | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): evidence has up to three nearest examples as doc_id:label:cosine."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index or fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches_of(batches):
            got = own.scores(b.column(2).to_pylist())
            s = np.array([x[0] for x in got], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([x[1] for x in got], pa.string())], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), (fold() == 0).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence string")
