"""Near-duplicates by SimHash with bit-sliced comparison.

Fingerprints of equal value are one class. Two fingerprints within 2 bits agree on at least two of four 16-bit quarters,
so each class is dealt to six buckets, one for each pair of quarters. In a bucket, fingerprints are stored in blocks of
64 as vertical bit planes: word j of a block holds bit j of its 64 fingerprints. A query's distance to all 64 is kept in
two carry-save bit counters and an overflow word; planes are added until every lane of a block has passed the radius,
when the block is abandoned. A bucket over a size is dealt anew by three parts of the bits its fingerprints do not share:
a pair within 2 bits agrees on one of three, so it meets there. After two such rounds at most 15 bits are left, so no
bucket has more than 2^15 distinct fingerprints, and all of them are compared by bit slices.

Defined results: a null or blank text has fingerprint zero and is linked like any other. Rows that share a doc_id are one
document with several fingerprints: each row comes back, with the class that its own fingerprint belongs to. A null
doc_id comes back with component_id null unless its fingerprint links it to others. Rows that repeat come back once
each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batches_of, components, discard, prepare, table

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Above so many distinct fingerprints a bucket is dealt anew.
BUCKET = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if more than half of the shingles' hashes have it."""
    import xxhash

    # Bytes lower-case only A to Z, and split at just the six white-space characters.
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    one = xxhash.xxh64_intdigest
    if n < 1:
        hashes = np.array([one(b" ".join(words), SEED)], np.uint64)
    else:
        hashes = np.fromiter(map(one, map(b" ".join, zip(*(words[k:] for k in range(shingle)))), repeat(SEED)), np.uint64, n)
    return _majority(hashes)


def _majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """(doc_id, row, fp): fp as a signed long of the same bits; row is that column of docs, or null."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    own = docs.select(F.col("doc_id").cast("long"), "text", (F.col(row) if row else F.lit(None).cast("long")).alias("row"))
    return own.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), own.schema["row"], T.StructField("fp", T.LongType())]))


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, n / 64): word [j, k] holds bit j of fingerprints 64 k to 64 k + 63."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def hits(query: np.ndarray, block: np.ndarray, vertical: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each (query, block) a word whose bit i says that lane i is within the radius (at most 2)."""
    out = np.zeros(len(query), np.uint64)
    live = np.arange(len(query))
    ones, twos, over = (np.zeros(len(query), np.uint64) for _ in range(3))
    full = ~np.uint64(0)
    for j in range(64):
        d = vertical[j, block[live]] ^ (np.uint64(0) - ((query[live] >> np.uint64(j)) & np.uint64(1)))
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if j % 8 == 7:
            past = over | (twos & ones) if radius == 2 else over | twos if radius == 1 else over | twos | ones
            keep = past != full
            if not keep.all():
                live, ones, twos, over = live[keep], ones[keep], twos[keep], over[keep]
            if not len(live):
                return out
    past = over | (twos & ones) if radius == 2 else over | twos if radius == 1 else over | twos | ones
    out[live] = ~past
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints within the radius that make the same components as all such pairs; keys sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    n_blocks = (sizes + 63) // 64
    first = np.cumsum(n_blocks) - n_blocks
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = first[group] * 64 + (np.arange(len(keys)) - starts[group])
    laid = np.zeros(int(n_blocks.sum()) * 64, np.uint64)
    row = np.full(len(laid), -1, np.int64)
    laid[lane], row[lane] = fps, np.arange(len(keys))
    vertical = np.concatenate([planes(laid[a : a + 64 * 4096]) for a in range(0, len(laid), 64 * 4096)], axis=1)
    parent = np.arange(len(keys))
    reps = n_blocks[group]
    ends = np.cumsum(reps)
    at = 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step)))
        q = np.repeat(np.arange(at, to), reps[at:to])
        blk = first[group[q]] + (np.arange(len(q)) - np.repeat(np.cumsum(reps[at:to]) - reps[at:to], reps[at:to]))
        found = hits(fps[q], blk, vertical)
        some = np.flatnonzero(found)
        lanes = np.unpackbits(found[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, l = np.nonzero(lanes)
        other = row[blk[some[i]] * 64 + l]
        mine = q[some[i]]
        ok = other > mine
        _join(parent, mine[ok], other[ok])
        at = to
    linked = parent != np.arange(len(keys))
    return fps[linked], fps[parent[linked]]


def _join(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite u[i] with v[i]; parent stays flat: parent[x] is the least of x's set."""
    while len(u):
        a, b = parent[u], parent[v]
        differ = a != b
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        if not len(u):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _bits(column, first: int, n: int):
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << n) - 1))


def _dealt(rows: DataFrame, parts: int = RADIUS + 1) -> DataFrame:
    """Each bucket of rows (fp, key, rest, width) anew by each of three parts of the bits that its key does not fix.

    At most two of the three parts can differ within the radius, so a pair meets in at least one.
    """
    options = []
    for i in range(parts):
        low, high = f"int(width * {i} div {parts})", f"int(width * {i + 1} div {parts})"
        own = F.expr(f"shiftrightunsigned(rest, {low}) & (shiftleft(1L, {high} - {low}) - 1L)")
        left = F.expr(f"(rest & (shiftleft(1L, {low}) - 1L)) | shiftleft(shiftrightunsigned(rest, {high}), {low})")
        options.append(F.struct(F.concat("key", F.array(F.lit(i).cast("long"), own)).alias("key"), left.alias("rest"), F.expr(f"width - ({high} - {low})").alias("width")))
    return rows.select("fp", F.explode(F.array(*options)).alias("o")).select("fp", "o.*")


def links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): pairs of fp of classes (fp) within the radius, enough to connect all that such pairs connect.

    Every pair is compared by bit slices in some bucket. Buckets of more than `bucket` fingerprints are dealt anew, by
    three parts of the bits that their fingerprints do not share yet: 32 bits, then 21 or 22, then at most 15, which
    bounds a bucket at 2^15 whatever the input.
    """
    quarter = [_bits(F.col("fp"), 16 * k, 16) for k in range(4)]
    options = []
    for a in range(4):
        for b in range(a):
            c, d = (k for k in range(4) if k not in (a, b))
            key = F.array(F.lit(a * 4 + b).cast("long"), quarter[a] * F.lit(1 << 16) + quarter[b])
            options.append(F.struct(key.alias("key"), (quarter[c] * F.lit(1 << 16) + quarter[d]).alias("rest"), F.lit(32).alias("width")))
    wide = classes.select("fp", F.explode(F.array(*options)).alias("o")).select("fp", "o.*")
    parts = []
    for level in range(3):
        sizes = table(wide.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        small = sizes if level == 2 else sizes.filter(F.col("n") <= bucket)
        parts.append(wide.join(small.select("key"), "key").select("key", "fp"))
        if level == 2 or not sizes.filter(F.col("n") > bucket).take(1):
            break
        wide = _dealt(wide.join(sizes.filter(F.col("n") > bucket).select("key"), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in _and_none(batches):
            if b is not None:
                held_k = np.r_[held_k, b.column(0).to_numpy(zero_copy_only=False)]
                held_f = np.r_[held_f, b.column(1).to_numpy(zero_copy_only=False)]
                if len(held_k) < 1 << 15:
                    continue
            if not len(held_k):
                continue
            cut = len(held_k) if b is None else int(np.searchsorted(held_k, held_k[-1]))
            if cut:
                u, v = bucket_links(held_k[:cut], held_f[:cut].view(np.uint64))
                held_k, held_f = held_k[cut:], held_f[cut:]
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    # A bucket's number may be shared by two buckets by chance: then their fingerprints are compared too, exactly.
    near = reduce(DataFrame.union, parts).select(F.xxhash64("key").alias("key"), "fp")
    return near.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def _and_none(batches):
    yield from batches
    yield None


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET, row: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    With row (a column of docs whose values tell rows apart) also that and kept: true for one row of each component, the
    one of the least doc_id (null last), then the least row.
    """
    fps = table(fingerprints(docs, shingle, row), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = table(fps.groupBy("fp").agg(F.min(order).alias("first")), "classes")
    pairs = table(links(classes.select("fp"), bucket), "links")
    roots = components(pairs)
    rooted = table(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = table(rooted.groupBy("root").agg(F.min("first").alias("best")), "least")
    named = table(rooted.select("fp", "root").join(least, "root").select("fp", "best"), "named")
    discard(classes, pairs, rooted, least)
    out = fps.join(named, "fp", "left")
    more = [F.col("row").alias(row), F.col("row").eqNullSafe(F.col("best.row")).alias("kept")] if row else []
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"), *more)
