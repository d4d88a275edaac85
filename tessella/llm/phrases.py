"""Phrase collocations from word-id suffix arrays.

Texts are cut into pieces and words, and gathered into shards of about SHARD words. A shard numbers its words (each language
has numbers of its own) and holds its texts as one array of numbers, 0 between pieces. Its suffix array is built by prefix
doubling in numpy, up to the longest phrase; the intervals of suffixes that share m words or more are the phrases of m words
with their counts. Shards are written to the shared folder once and read by each level.

Only phrases whose parts are all frequent can be frequent, so levels go up: words, pairs, then phrases of three and more.
Each level counts hashes, which may only overstate a count, and sets the frequent ones' bits in a filter. A shard sends its
hashes as arrays, dealt by their first bits to so many buckets that each holds about as much at any size of the corpus; four
bytes and a count go for each hash. At last words and phrases that all filters pass are sent as text, whose counts are
merged by language and phrase and are exact. A filter has 16 bits a frequent key and FILTER bits at most; when frequent keys
outgrow that, it lets more through, and the counts stay the same.

Defined results: a null text counts as empty, a null lang is `und`. Repeated rows count as often as they occur. Other columns
are ignored. An empty table gives an empty result. A text is split between pieces when it is longer than a shard; one piece
is held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import batches_of, discard, prepare, settle, table

#: Words of a phrase at most, its least count, the result's rows a language, and the share that makes a part superfluous.
MOST_WORDS, LEAST, TOP, INSIDE = 4, 30, 2000, (80, 100)
UNKNOWN = "und"
#: Words of a shard, about; bits of a filter at most (16 MB).
SHARD, FILTER = 1 << 20, 1 << 27
#: First bits of a hash that tell its place in a filter.
PLACE = 36
DEALT = "bucket int, keys binary, counts binary"
#: Odd multipliers that mix hashes.
MIX, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
BREAK = re.compile(rb"[.,;:!?\n-\r]")
SHARDS = "langs array<string>, totals array<bigint>, words array<string>, lang_of binary, hashes array<bigint>, counts array<bigint>, ids binary"


class Shard:
    """The words and pieces of some texts."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.known: list[dict[bytes, int]] = []
        self.words: list[bytes] = []
        self.lang_of: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, raw: bytes, lang: str) -> None:
        code = self.langs.setdefault(lang, len(self.langs))
        if code == len(self.known):
            self.known.append(dict.fromkeys((bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"), 0))
        known, tokens = self.known[code], TOKEN.findall(raw)
        for w in set(tokens).difference(known):
            self.words.append(w)
            self.lang_of.append(code)
            known[w] = len(self.words)
        ids = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
        self.parts += [ids, np.zeros(1, np.int32)]
        self.size += len(ids) + 1

    def row(self) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.words) + 1)[1:]
        lang_of = np.array(self.lang_of, np.int32)
        totals = np.bincount(lang_of, counts, len(self.langs)).astype(np.int64)
        seeds = [xxhash.xxh64_intdigest(x.encode()) for x in self.langs]
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seeds[c]) for w, c in zip(self.words, self.lang_of)), np.uint64, len(self.words))
        texts = pa.array(self.words, pa.binary()).cast(pa.string())
        values = [list(self.langs), totals, texts, lang_of.tobytes(), hashes.view(np.int64), counts, ids.tobytes()]
        kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        one = lambda v, kind: pa.array([v], kind) if isinstance(v, bytes) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind.value_type))
        return pa.RecordBatch.from_arrays([one(v, kind) for v, kind in zip(values, kinds)], [c.split()[0] for c in SHARDS.split(", ")])


def segments(raw: bytes, most: int) -> Iterator[bytes]:
    """raw in parts of about `most` bytes that end at the ends of pieces."""
    at = 0
    while len(raw) - at > most:
        end = BREAK.search(raw, at + most)
        if end is None:
            break
        yield raw[at : end.end()]
        at = end.end()
    yield raw[at:] if at else raw


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """One row a shard, in the shared folder: its words with languages, hashes and counts, and its array of word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Shard()
        for b in batches_of(batches):
            for text, lang in zip(b.column(0), b.column(1)):
                for raw in segments((text.as_py() or "").encode("utf-8").lower(), 4 * size):  # bytes.lower changes A-Z only
                    now.add(raw, lang.as_py())
                    if now.size >= size:
                        yield now.row()
                        now = Shard()
        if now.size:
            yield now.row()

    prepare(docs.sparkSession)
    got = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    # A shard is a row of megabytes, so each is a row group of its own: Spark's reader and writer hold one row group at least.
    return table(got.mapInArrow(run, SHARDS), "phrase-shards", **{"parquet.block.row.count.limit": 1})


def suffixes(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ids in the order of their first `depth` numbers (a power of two), and how many of these each shares
    with the one before it. Numbers beyond the end count as 0."""
    rank, reach = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable") if depth == 1 else None
    while reach < depth:
        ahead = np.zeros_like(rank)
        ahead[:-reach or None] = rank[reach:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty_like(rank)
        # Dense ranks: 0 stays 0 only for suffixes of 0s, which no phrase begins with.
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(ordered) else ordered
        reach *= 2
    shared, still = np.zeros(len(ids), np.int8), np.ones(max(0, len(ids) - 1), bool)
    ends = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    for k in range(depth):
        there = ends[order + k]
        still &= there[1:] == there[:-1]
        shared[1:] += still
    return order, shared


def phrases(ids: np.ndarray, order: np.ndarray, shared: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each phrase of m words first stands in the order of suffixes (positions in ids), and its count."""
    first = np.flatnonzero(shared < m)
    n = np.diff(np.append(first, len(ids)))
    at = order[first]
    ends = np.concatenate([ids, np.zeros(m, ids.dtype)])
    whole = np.ones(len(at), bool)
    for k in range(m):
        whole &= ends[at + k] > 0
    return at[whole], n[whole]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs from hashes of words."""
    x = a * MIX + b
    x = (x ^ (x >> np.uint64(29))) * STIR
    return x ^ (x >> np.uint64(32))


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - PLACE)) % np.uint64(8 * len(bits))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def dealt(hashes: np.ndarray, n: np.ndarray, deal: int, least: int) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, counts) of distinct hashes: buckets by the first `deal` bits, keys the next 32. Counts of 255 and more
    are sent as 255 where that is frequent already."""
    kind = np.uint8 if least <= 255 else np.uint32
    order = np.argsort(hashes)
    hashes, n = hashes[order], np.minimum(n[order], np.iinfo(kind).max).astype(kind)
    buckets, first = np.unique(hashes >> np.uint64(64 - deal), return_index=True)
    keys, ends = ((hashes >> np.uint64(32 - deal)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), [*first[1:], len(hashes)]
    parts = [(keys[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(first, ends)]
    yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array([x for x, _ in parts], pa.binary()), pa.array([x for _, x in parts], pa.binary())], ["bucket", "keys", "counts"])


def frequent(sent: DataFrame, deal: int, least: int) -> np.ndarray:
    """A filter of the hashes whose counts come to `least`; the driver gets its words that are not 0, FILTER / 64 at most."""

    def add(key, table):
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32)
        n = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8 if least <= 255 else np.uint32)
        each, at = np.unique(keys, return_inverse=True)
        often = each[np.bincount(at, n) >= least].astype(np.int64) | key[0].as_py() << 32
        return pa.table([pa.array(often >> (deal + 32 - PLACE))], ["place"])

    often = table(sent.groupBy("bucket").applyInArrow(add, "place long"), "phrase-often")
    size = min(FILTER, max(1 << 12, 1 << (16 * often.count()).bit_length()))
    place = F.pmod(F.col("place"), F.lit(size)).cast("long")
    got = often.select(place.alias("p")).groupBy(F.expr("p div 64").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("word")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[got["slot"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    discard(often)
    return out.view(np.uint8)


def masked(row: dict, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's numbers with 0 for words that are not frequent, runs of 0s made one; and the words' hashes from number 1 on."""
    hashes = np.concatenate([np.zeros(1, np.uint64), row["hashes"].view(np.uint64)])
    keep = passes(bits, hashes)
    keep[0] = False
    ids = np.frombuffer(row["ids"], np.int32)
    ids = np.where(keep[ids], ids, 0)
    return ids[(ids > 0) | (np.append(ids[1:], 0) > 0)], hashes


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches_of(batches, 1):
        yield {n: c[0].as_py() if pa.types.is_binary(c.type) else c[0].values if n in ("langs", "words") else c[0].values.to_numpy() for n, c in zip(b.schema.names, b.columns)}


def singles(made: DataFrame, deal: int, least: int) -> DataFrame:
    """The words of each shard, dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, at = np.unique(row["hashes"].view(np.uint64), return_inverse=True)
            yield from dealt(hashes, np.bincount(at, row["counts"]).astype(np.int64), deal, least)

    return made.select("hashes", "counts").mapInArrow(run, DEALT)


def longer(made: DataFrame, filters: list[np.ndarray], most: int, deal: int, least: int) -> DataFrame:
    """The phrases of each shard, dealt: with one filter (of words) pairs, with two (and of pairs) those of three words or
    more, all of whose pairs pass."""
    sent = made.sparkSession.sparkContext.broadcast(filters)  # FILTER bits each at most
    lengths = [2] if len(filters) == 1 else [*range(3, most + 1)]
    depth = 1 << (lengths[-1] - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, hashes = masked(row, sent.value[0])
            found, counts = [], []
            for m, at, n in passing(ids, hashes, sent.value[1:], lengths, depth):
                found.append(joined(hashes, ids, at, m))
                counts.append(n)
            each, at = np.unique(np.concatenate(found), return_inverse=True)
            yield from dealt(each, np.bincount(at, np.concatenate(counts)).astype(np.int64), deal, least)

    return made.select("hashes", "ids").mapInArrow(run, DEALT)


def joined(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """The hash of the m words at each place."""
    out = hashes[ids[at]]
    for k in range(1, m):
        out = mixed(out, hashes[ids[at + k]])
    return out


def passing(ids: np.ndarray, hashes: np.ndarray, filters: list[np.ndarray], lengths: list[int], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, counts) of phrases of some lengths whose pairs, and longer ones themselves, pass the filters there are."""
    order, shared = suffixes(ids, depth)
    pair = None
    if filters and len(ids):
        ends = np.append(ids[1:], 0)
        pair = np.append(passes(filters[0], mixed(hashes[ids], hashes[ends])), np.zeros(max(lengths), bool))
    for m in lengths:
        at, n = phrases(ids, order, shared, m)
        if pair is not None:
            fine = np.ones(len(at), bool)
            for k in range(m - 1):
                fine &= pair[at + k]
            at, n = at[fine], n[fine]
        if m > 2 and len(filters) > 1:
            fine = passes(filters[1], joined(hashes, ids, at, m))
            at, n = at[fine], n[fine]
        yield m, at, n


def grams(made: DataFrame, filters: list[np.ndarray], most: int) -> DataFrame:
    """(lang, phrase, n) of each shard: words, and phrases of up to `most` words, that pass the filters."""
    sent = made.sparkSession.sparkContext.broadcast(filters)
    depth, part = 1 << (most - 1).bit_length(), 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, hashes = masked(row, sent.value[0])
            langs, texts, lang_of = row["langs"], row["words"], np.frombuffer(row["lang_of"], np.int32)
            for m, at, n in passing(ids, hashes, sent.value[1:], [*range(1, most + 1)], depth):
                for a in range(0, len(at), part):
                    own = at[a : a + part]
                    words = [texts.take(pa.array(ids[own + k] - 1)) for k in range(m)]
                    phrase = words[0] if m == 1 else pc.binary_join_element_wise(*words, " ")
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang_of[ids[own] - 1])), phrase, pa.array(n[a : a + part].astype(np.int64))], ["lang", "phrase", "n"])

    return made.select("langs", "words", "lang_of", "hashes", "ids").mapInArrow(run, "lang string, phrase string, n long")


def scored(often: DataFrame, inside: tuple[int, int] = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of frequent phrases (lang, phrase, f) of two words or more that no longer one makes
    superfluous. Products are decimals of 38 digits, divided as whole numbers."""
    big = lambda c: F.col(c).cast("decimal(20,0)")
    words = F.split("phrase", " ", -1)
    sized = often.withColumn("w", words).withColumn("m", F.size("w"))
    several = sized.filter("m > 1")
    cut = several.select("lang", "phrase", F.col("f").alias("a"), "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    heads = often.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = often.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    both = both.withColumn("a_", big("a") * F.lit(2000000).cast("decimal(7,0)")).withColumn("lr", big("l") + big("r")).withColumn("score", F.expr("a_ div lr"))
    best = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every contiguous part of two words or more that is shorter than its phrase.
    longer = several.filter("m > 2")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda a: F.array_join(F.slice("w", a, n), " "))))
    held = longer.select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    got = best.join(held, ["lang", "phrase"], "left")
    gone = big("within") * F.lit(inside[1]).cast("decimal(3,0)") >= big("a") * F.lit(inside[0]).cast("decimal(3,0)")
    return got.filter(~F.coalesce(gone, F.lit(False))).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))


def first_of(found: DataFrame, top: int) -> DataFrame:
    """found with rank: the first `top` of each lang by score, count and phrase; drawn from 64 parts of each lang first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, inside: tuple[int, int] = INSIDE, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two to most_words words."""
    made = shards(docs, shard)
    # 1,024 buckets, and for more than 24 shards a bucket more of them, so that a bucket stays near 24 shards' hashes.
    deal = min(20, max(10, (made.count() // 24).bit_length()))
    filters = [frequent(singles(made, deal, least), deal, least)]
    filters.append(frequent(longer(made, filters, 2, deal, least), deal, least))
    if most_words > 2:
        filters.append(frequent(longer(made, filters, most_words, deal, least), deal, least))
    often = table(grams(made, filters, most_words).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "phrase-counts")
    totals = table(made.select(F.explode(F.arrays_zip("langs", "totals")).alias("e")).select(F.col("e.langs").alias("lang"), F.col("e.totals").alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    found = table(first_of(scored(often, inside), top), "phrase-found")
    discard(made, often)
    settle(docs.sparkSession)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql() -> str:
    joined = " || ' ' || ".join
    lead = lambda k: "w" if k == 0 else f"lead(w, {k}) OVER o"
    grams = " UNION ALL ".join(f"SELECT lang, {joined(f'w{k}' for k in range(m))} AS phrase, {m} AS m FROM g WHERE w{m - 1} IS NOT NULL" for m in range(1, MOST_WORDS + 1))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, '{UNKNOWN}') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents
), p AS (SELECT rid, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM t
), ws AS (SELECT rid, lang, i, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), w AS (SELECT rid, lang, i, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM ws
), g AS MATERIALIZED (SELECT lang, {', '.join(f'{lead(k)} AS w{k}' for k in range(MOST_WORDS))} FROM w WINDOW o AS (PARTITION BY rid, i ORDER BY j)
), n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang
), f AS MATERIALIZED (SELECT lang, phrase, any_value(m) AS m, count(*) AS f FROM ({grams}) GROUP BY lang, phrase HAVING count(*) >= {LEAST}
), s AS (SELECT lang, phrase, m, f, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), c AS (SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM s)
), sc AS (SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, CAST(2000000::HUGEINT * c.f // (h.f::HUGEINT + t.f) AS BIGINT) AS score FROM c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), inner_ AS (SELECT lang, f, array_to_string(w[b:b + x - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - x + 2)) AS b FROM (SELECT *, unnest(range(2, m)) AS x FROM s))
), held AS (SELECT lang, phrase, max(f) AS within FROM inner_ GROUP BY ALL
), kept AS (SELECT sc.* FROM sc LEFT JOIN held USING (lang, phrase) WHERE within IS NULL OR {INSIDE[1]}::HUGEINT * within < {INSIDE[0]}::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}"""


SQL = _sql()
