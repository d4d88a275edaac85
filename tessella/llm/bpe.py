"""Byte-level BPE encoding and decoding with overlapping chunks.

Every text is cut into chunks that overlap (a text of up to a chunk is one). Chunks are split into pre-tokens, each from its
own start, which may fall inside a pre-token. The pattern looks ahead but never back, so where two neighbours share a
pre-token boundary inside the overlap, all later boundaries of the right one are the true ones: there they are stitched.
If no boundary is shared the left scan runs on until one is. The pieces are then encoded, each by itself, and decoding
concatenates the tokens' bytes. The chunks of a text of over `deal` characters are dealt out as rows and scanned in
parallel by many tasks; those of other texts are scanned where the text is read. Cutting copies each character once.

A chunk's last pre-tokens may depend on what follows it (a run can go on, `\\s+(?!\\S)` looks one character ahead), so
boundaries that lie on the last character of a chunk's text are not trusted.

Defined results: null counts as empty (no ids). Rows that repeat come back once each. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, prepare

CHUNK, OVERLAP, DEAL, CACHE = 1 << 12, 1 << 7, 1 << 16, 500_000
_LOADED: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encodes pre-tokens by the ranks of a tiktoken file and remembers short ones."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, ranks: str, pattern: str) -> Codec:
        if (ranks, pattern) not in _LOADED:
            _LOADED[ranks, pattern] = cls(ranks, pattern)
        return _LOADED[ranks, pattern]

    def piece(self, p: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        ids = array("I", self.core._encode_single_piece(p.encode("utf-8"))).tobytes()
        if len(p) <= 32:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[p] = ids
        return ids

    def encode(self, pieces: list[str]) -> bytes:
        found = [*map(self.known.get, pieces)]
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.known.get(pieces[i]) or self.piece(pieces[i])
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return self.core.decode_bytes(memoryview(ids).cast("I").tolist())

    def ends(self, text: str, start: int = 0) -> Iterator[int]:
        return (m.end() for m in self.pattern.finditer(text, start))


def boundaries(codec: Codec, text: str, last: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk's text; unless it is the last, those that more text may move are left out."""
    ends = list(codec.ends(text))
    if not last:
        while ends and ends[-1] >= len(text) - 1:
            ends.pop()
    return ends


def stitch(codec: Codec, parts: list[tuple[int, str, list[int]]]) -> list[str]:
    """The pre-tokens of a whole text from its chunks (start, text, ends within the chunk), in order."""
    whole = "".join(text[: parts[i + 1][0] - start] if i + 1 < len(parts) else text for i, (start, text, _) in enumerate(parts))
    true = [0]
    for i, (start, _, ends) in enumerate(parts):
        own = [start + e for e in ends]
        if i:
            # The left side's boundaries are the true ones so far: find the first that this chunk has too.
            at = next((k for k in range(bisect_left(true, start), len(true)) if (j := bisect_left(own, true[k])) < len(own) and own[j] == true[k]), None)
            if at is not None:
                del true[at + 1 :]
            else:
                marks = set(own)
                limit = parts[i + 1][0] if i + 1 < len(parts) else len(whole)
                for e in codec.ends(whole, true[-1]):
                    true.append(e)
                    if e in marks or e > limit:
                        break
                if true[-1] not in marks:
                    continue
        true += own[bisect_left(own, true[-1] + 1) :]
    if true[-1] < len(whole):
        true += list(codec.ends(whole, true[-1]))
    return [whole[a:b] for a, b in zip(true, true[1:])]


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str, bool]]:
    """(start, text, whether it is the last) of each chunk; the last one ends the text, none lies in its neighbour."""
    out = [(a, text[a : a + chunk + overlap], a + chunk + overlap >= len(text)) for a in range(0, len(text), chunk)]
    return out[: next((i for i, x in enumerate(out) if x[2]), -1) + 1]


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, tokens: bool = False, deal: int = DEAL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of docs; with tokens also (ids, decoded) as bytes."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if tokens else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if tokens else "")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    def row(codec: Codec, doc_id: int | None, pieces: list[str]) -> tuple:
        ids = codec.encode(pieces)
        decoded = codec.decode(ids)
        return (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids, decoded) if tokens else ()))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks, pattern)
        for b in batches_of(batches):
            rows = []
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                parts = [(start, part, boundaries(codec, part, last)) for start, part, last in cut(x.as_py(), chunk, overlap)]
                rows.append(row(codec, d, stitch(codec, parts) if parts else []))
            yield batch(rows)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        for b in batches_of(batches, 1):
            rid, doc_id, text = (c[0].as_py() for c in b.columns)
            rows = [(rid, doc_id, start, last, part) for start, part, last in cut(text, chunk, overlap)]
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 1000]), kinds)], ["rid", "doc_id", "start", "last", "part"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks, pattern)
        for b in batches_of(batches):
            ends = [array("I", boundaries(codec, t.as_py(), z.as_py())).tobytes() for t, z in zip(b.column(4), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(ends, pa.binary())], ["rid", "doc_id", "start", "part", "ends"])

    def join(group):
        codec = Codec.load(ranks, pattern)
        rows = sorted(zip(group["start"].to_pylist(), group["part"].to_pylist(), (list(memoryview(e).cast("I")) for e in group["ends"].to_pylist())))
        return pa.Table.from_batches([batch([row(codec, group["doc_id"][0].as_py(), stitch(codec, rows))])])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = base.filter(F.length("text") <= deal).mapInArrow(direct, schema)
    # A row's number only has to hold from the cutting of its text to the shuffle that follows.
    long = base.filter(F.length("text") > deal).select(F.monotonically_increasing_id().alias("rid"), "*")
    parts = long.mapInArrow(apart, "rid long, doc_id long, start int, last boolean, part string")
    parts = parts.repartition("rid", "start").mapInArrow(scan, "rid long, doc_id long, start int, part string, ends binary")
    return short.union(parts.groupBy("rid").applyInArrow(join, schema))
