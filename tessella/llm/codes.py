"""Vector compression by product codes: each vector becomes one code a part, learned by integer k-means.

Vectors are quantised to integers and kept as columnar blocks, one row a block: for each part and position within it the
values of all the block's vectors, as bytes. A round is one treeAggregate over the blocks: distances to a part's entries are
accumulated position by position for a whole block, and sums and counts of the assigned vectors are added with np.add.at
into int64 tensors of fixed size (parts x entries x positions), which merge through a tree. All arithmetic is on
integers, so results do not depend on partitions. Blocks are in the shared folder, so a lost executor costs one block's work.

Defined results: rows whose vector is null, or has a null or non-finite component, go. Fewer than `entries` kept rows make
as many entries. Of equal vec_ids the lesser vector, componentwise, comes first; a null vec_id comes last. Rows that repeat
come back once each. Other columns are ignored. An empty table gives an empty result. Vectors of several lengths, or of a
length that parts do not divide, and components too large for 64-bit sums, raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, joined_by, prepare, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors in a block at most.
BLOCK = 4096
#: Rows whose sums must fit in 64 bits, which bounds the components.
MOST_ROWS = 1 << 34
BLOCKS = "ids binary, nulls binary, labels binary, label_nulls binary, n int, dims int, data binary"
RESULT = "vec_id long, label int, code string, error long"


def blocks(vectors: DataFrame) -> DataFrame:
    """Columnar blocks of the kept rows of (vec_id, embedding, label), in the shared folder; data is int32 (dims, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, BLOCK):
            lengths = set(pc.unique(pc.list_value_length(b.column(1))).to_pylist())
            if len(lengths) > 1:
                raise ValueError("vectors of several lengths")
            dims = lengths.pop() if lengths else 0
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims).T
            q = np.floor(x * SCALE)
            if q.size and np.abs(q).max() > min(2**31 - 1, (2**63 // MOST_ROWS), int((2**61 / max(1, dims)) ** 0.5)):
                raise ValueError("components too large for 64-bit sums of squares")
            one = lambda c, kind: (c.fill_null(0).to_numpy(zero_copy_only=False).astype(kind).tobytes(), c.is_null().to_numpy(zero_copy_only=False).tobytes())
            row = [*one(b.column(0), np.int64), *one(b.column(2), np.int32), b.num_rows, dims, np.ascontiguousarray(q, np.int32).tobytes()]
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, [pa.binary()] * 4 + [pa.int32()] * 2 + [pa.binary()])], names)

    prepare(vectors.sparkSession)
    return table(kept(vectors).mapInArrow(run, BLOCKS), "blocks")


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) of vectors whose components are all finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    got = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    return got.filter(F.col("embedding").isNotNull() & F.forall("embedding", fine))


def values(row) -> np.ndarray:
    """A block's integers (dims, n)."""
    return np.frombuffer(row["data"], np.int32).reshape(row["dims"], row["n"]).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors of one part x (positions, n), the nearest entry of book (entries, positions) and its squared distance."""
    far = np.zeros((len(book), x.shape[1]), np.int64)
    for p in range(len(x)):
        off = x[p] - book[:, p, None]
        far += off * off
    at = far.argmin(axis=0)  # the first of equals
    return at, far[at, np.arange(x.shape[1])]


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, positions) from the kept rows of the least vec_ids."""
    rows = kept(vectors).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()  # one row an entry
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    x = np.floor(np.array([r["embedding"] for r in rows], float) * SCALE).astype(np.int64)
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} components do not make {parts} equal parts")
    return x.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def refine(cut: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of its vectors' mean; entries without vectors stay."""
    parts, entries, width = books.shape
    shared = cut.sparkSession.sparkContext.broadcast(books)

    def add(total, row):
        sums, counts = total
        x, now = values(row), shared.value
        for p in range(parts):
            own = x[p * width : (p + 1) * width]
            at = nearest(own, now[p])[0]
            np.add.at(sums[p], at, own.T)
            np.add.at(counts[p], at, 1)
        return sums, counts

    def merge(a, b):
        return a[0] + b[0], a[1] + b[1]

    zero = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    sums, counts = cut.select("n", "dims", "data").rdd.treeAggregate(zero, add, merge, depth=3)
    shared.unpersist()
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)


def train(cut: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        books = refine(cut, books)
    return books


def assign(cut: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1):
            row = b.to_pylist()[0]
            x, width = values(row), books.shape[2]
            both = [nearest(x[p * width : (p + 1) * width], books[p]) for p in range(len(books))]
            codes = np.stack([at for at, _ in both], axis=1).astype(np.uint8)
            error = sum(far for _, far in both)
            one = lambda v, kind, nulls: pa.array(np.frombuffer(row[v], kind), mask=np.frombuffer(row[nulls], bool))
            yield pa.RecordBatch.from_arrays([one("ids", np.int64, "nulls"), one("labels", np.int32, "label_nulls"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return cut.mapInArrow(run, RESULT)


def digest(books: np.ndarray) -> str:
    """Of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per kept row of vectors."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    cut = blocks(vectors)
    books = train(cut, first_books(vectors, parts, entries), rounds)
    coded = table(assign(cut, books), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    both = joined_by(coded, table(sums, "label-errors"), "label")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    floor = lambda s, n: f"CAST(({s} - ((({s}) % {n}) + {n}) % {n}) // {n} AS BIGINT)"
    near = lambda c: f"SELECT rid, part, k, d FROM (SELECT x.rid, x.part, c.k, sum((x.x - c.y) * (x.x - c.y)) AS d FROM x JOIN {c} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, k) = 1"
    rounds = "".join(
        f""", a{i} AS MATERIALIZED ({near(f'c{i}')}
), m{i} AS (SELECT x.part, k, pos, sum(x.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN x USING (rid, part) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (SELECT c.part, c.k, c.pos, coalesce({floor('s', 'n')}, y) AS y FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.k = c.k AND m.pos = c.pos
)"""
        for i in range(ROUNDS)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT rid, len(e) // {PARTS} AS w, unnest(e) AS x, unnest(range(len(e))) AS i FROM v
), x AS MATERIALIZED (SELECT rid, i // w AS part, i % w AS pos, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u
), c0 AS MATERIALIZED (SELECT part, rid AS k, pos, x AS y FROM x WHERE rid < {ENTRIES}
){rounds}, z AS MATERIALIZED ({near(f'c{ROUNDS}')}
), r AS (SELECT rid, string_agg(format('{{:02x}}', k), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY rid
), h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, k, pos)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (rid), h"""


SQL = _sql()
