"""Media columns: lossless 8-bit audio of each payload, stored as content-defined chunks that are kept once.

A text's payload (UTF-8, padded with spaces to a multiple of 192 bytes) becomes the samples of a mono 8-bit PCM WAV file.
A gear hash rolls over the file's bytes; cuts fall where its low bits are zero, between a least and a most chunk size.
Each chunk is named by its SHA-256 digest. What is stored is two tables: the files, each an ordered list of digests with
the bytes of those chunks that no other row has, and the chunks that rows share, each once, found by a grouping on digest.

A file's text never moves. A pass over digests alone counts them; those of more than one row set bits of a filter of fixed
size, and only the bytes of chunks that the filter knows are shuffled, to be stored once. A chunk that hits the filter by
chance goes to the chunk table like a shared one, so each chunk is stored once in any case; the filter only saves shuffles.

Reading back gives each distinct list once: a list of one shared chunk is that chunk's row, other lists with shared chunks
meet them in an equi-join on digest, and the rest are whole in their row. Every chunk is checked against its digest.

Defined results: a null text counts as empty (a payload of 192 spaces). Equal texts give equal values. Rows that repeat
come back once each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, prepare, table

UNIT, RATE, HEADER = 192, 8000, 44
LEAST, MASK, MOST = 1024, (1 << 12) - 1, 16384
#: 256 gear values from a fixed multiplicative rule.
GEAR = np.array([(i + 1) * 0x9E3779B1 % (1 << 32) ^ ((i + 1) * 0x85EBCA6B % (1 << 32)) >> 13 for i in range(256)], np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def wav(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono samples (their count is even, so no pad byte is needed)."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def unwav(file: bytes) -> bytes:
    if file[:4] != b"RIFF" or file[8:16] != b"WAVEfmt " or file[36:40] != b"data":
        raise ValueError("not a WAV file of this kind")
    n = struct.unpack("<I", file[40:44])[0]
    if len(file) != HEADER + n:
        raise ValueError("a WAV file of another length than it says")
    return file[HEADER:]


def cuts(data: bytes, least: int = LEAST, most: int = MOST, mask: int = MASK) -> list[int]:
    """Ends of the chunks. The hash at i covers the last 32 bytes: sum of GEAR[byte at i - k] << k."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        shifted = h[:-k] << np.uint32(k) if len(h) > k else h[:0]
        h = h.copy()
        h[k:] += shifted
    marks = np.flatnonzero((h >> np.uint32(20)) & np.uint32(mask) == 0) + 1
    ends, at = [], 0
    while len(data) - at > most or (len(data) - at > least and len(marks)):
        i = int(np.searchsorted(marks, at + least))
        end = min(int(marks[i]) if i < len(marks) else len(data), at + most, len(data))
        ends.append(end)
        at = end
        if at == len(data):
            return ends
    return [*ends, len(data)]


def feature(samples: bytes) -> str:
    """Mean, root mean square about the middle, zero crossings and a 8-bin histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    c = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((c[1:] >= 0) != (c[:-1] >= 0)))
    bins = np.bincount(x >> 5, minlength=8)
    sums = int(x.sum(dtype=np.int64)), int((c.astype(np.int64) ** 2).sum())
    return f"mean={sums[0] / len(x):.4f};rms={(sums[1] / len(x)) ** 0.5:.4f};zc={crossings};hist={','.join(map(str, bins))}"


def _pieces(text: str | None) -> tuple[int, list[bytes]]:
    body, n = payload(text)
    file = wav(body)
    ends = cuts(file)
    return n, [file[a:b] for a, b in zip([0, *ends], ends)]


#: Bits of the filter of shared chunks; its size is fixed, so it may be broadcast (8 MB). A chunk that no rows share hits it by
#: chance in a part of about (shared chunks) / FILTER of all cases; well beyond 2^26 shared chunks all bytes move once.
FILTER = 1 << 26


def _place(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") % FILTER


def _digests(text: str | None) -> tuple[int, list[bytes], list[bytes]]:
    n, pieces = _pieces(text)
    return n, [hashlib.sha256(c).digest() for c in pieces], pieces


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def recipes(docs: DataFrame) -> DataFrame:
    """(digest, place): the chunks of each row, each digest once a row, and their bits in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            digests = [d for x in b.column(0) for d in set(_digests(x.as_py())[1])]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([*map(_place, digests)], pa.int64())], ["digest", "place"])

    return docs.select("text").mapInArrow(run, "digest binary, place long")


def shared_filter(docs: DataFrame) -> np.ndarray:
    """The bits of chunks that more than one row has; the driver gets FILTER / 64 pairs of longs at most."""
    shared = recipes(docs).groupBy("digest").agg(F.count("*").alias("n"), F.first("place").alias("place")).filter("n > 1")
    words = shared.groupBy(F.expr("place div 64").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("word"))
    out = np.zeros(FILTER // 64, np.uint64)
    got = words.toArrow()
    out[got["slot"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    return out


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored tables, in the shared folder: (doc_id, n_bytes, list, digests, chunks), a row for each row of docs, and the
    shared chunks (digest, bytes, whole).

    list names the ordered digests; chunks[i] has the bytes of chunk i or null if it is in the chunk table, or earlier in
    the row. whole: some file is this chunk alone.
    """
    prepare(docs.sparkSession)
    rows = _texts(docs)
    known = docs.sparkSession.sparkContext.broadcast(shared_filter(rows))

    def shared(digest: bytes) -> bool:
        at = _place(digest)
        return bool(int(known.value[at >> 6]) >> (at & 63) & 1)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            out: dict[bytes, tuple[bytes, bool]] = {}
            for x in b.column(0):
                _, names, parts = _digests(x.as_py())
                for d, c in zip(names, parts):
                    if shared(d):
                        out[d] = c, len(parts) == 1 or (d in out and out[d][1])
            yield pa.RecordBatch.from_arrays([pa.array([*out], pa.binary()), pa.array([c for c, _ in out.values()], pa.binary()), pa.array([w for _, w in out.values()], pa.bool_())], ["digest", "bytes", "whole"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.binary())
        for b in batches_of(batches):
            sizes, names, ids, own = [], [], [], []
            for x in b.column(1):
                n, digests, parts = _digests(x.as_py())
                first = {d: i for i, d in reversed([*enumerate(digests)])}
                sizes.append(n)
                names.append(digests)
                ids.append(hashlib.sha256(b"".join(digests)).digest())
                own.append([c if first[d] == i and not shared(d) else None for i, (d, c) in enumerate(zip(digests, parts))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(names, kinds), pa.array(own, kinds)], ["doc_id", "n_bytes", "list", "digests", "chunks"])

    each = rows.select("text").mapInArrow(pieces, "digest binary, bytes binary, whole boolean")
    chunks = table(each.groupBy("digest").agg(F.any_value("bytes").alias("bytes"), F.max("whole").alias("whole")), "chunks")
    return table(rows.mapInArrow(lists, "doc_id long, n_bytes long, list binary, digests array<binary>, chunks array<binary>"), "lists"), chunks


def _checked(digest: bytes, chunk: bytes) -> bytes:
    if hashlib.sha256(chunk).digest() != digest:
        raise ValueError("a stored chunk differs from its digest")
    return chunk


def _apart(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of lists whose chunks are all in the row, and the others."""
    missing = F.size(F.array_except("digests", F.expr("transform(filter(arrays_zip(digests, chunks), x -> x.chunks IS NOT NULL), x -> x.digests)"))) > 0
    return lists.filter(~missing), lists.filter(missing)


def _put_together(parts: DataFrame, columns: list[str]) -> DataFrame:
    """columns of parts and media: from digests, chunks and brought (digest, bytes), each chunk checked."""
    schema = ", ".join(f"{c} {dict(parts.dtypes)[c]}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            at, out = len(columns), []
            for names, own, more in zip(b.column(at), b.column(at + 1), b.column(at + 2)):
                names, have = names.as_py(), {x["digest"]: x["bytes"] for x in more.as_py() or ()}
                have |= {d: c for d, c in zip(names, own.as_py()) if c is not None}
                have = {d: _checked(d, c) for d, c in have.items()}
                out.append(b"".join(have[d] for d in names))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.binary())], [*columns, "media"])

    return parts.select(*columns, "digests", "chunks", "brought").mapInArrow(run, f"{schema}, media binary")


def shared_files(lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """(list, media): each distinct file of rows (some of) whose chunks are in the chunk table."""
    mixed = _apart(lists)[1].filter(F.size("digests") > 1).groupBy("list").agg(F.any_value("digests").alias("digests"), F.any_value("chunks").alias("chunks"))
    mixed = table(mixed, "mixed-lists")
    needs = mixed.select("list", F.explode(F.array_distinct("digests")).alias("digest"))
    brought = needs.join(chunks.select("digest", "bytes"), "digest").groupBy("list").agg(F.collect_list(F.struct("digest", "bytes")).alias("brought"))
    many = _put_together(mixed.join(brought, "list"), ["list"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            names = [hashlib.sha256(d.as_py()).digest() for d, c in zip(b.column(0), b.column(1)) if _checked(d.as_py(), c.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), b.column(1)], ["list", "media"])

    return chunks.filter("whole").select("digest", "bytes").mapInArrow(run, "list binary, media binary").union(many)


def files(stored: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(doc_id, n_bytes, media): the file of every row, put together from its chunks."""
    lists, chunks = stored
    prepare(lists.sparkSession)
    own, others = _apart(lists)
    nothing = F.lit(None).cast("array<struct<digest:binary,bytes:binary>>").alias("brought")
    alone = _put_together(own.select("*", nothing), ["doc_id", "n_bytes"])
    return alone.union(others.select("doc_id", "n_bytes", "list").join(shared_files(lists, chunks), "list").select("doc_id", "n_bytes", "media"))


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """The digest columns and the feature of each file of media (..., media), with its other columns."""
    columns = [c for c in media.columns if c != "media"]
    names = [x.split()[0] for x in _FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for b in batches_of(batches):
            rows = []
            for x in b.column(len(columns)):
                file = x.as_py()
                body = unwav(file)
                rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(body)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [*columns, *names])

    schema = ", ".join(f"{c} {dict(media.dtypes)[c]}" for c in columns)
    return media.select(*columns, "media").mapInArrow(run, f"{schema}, {_FEATURES}")


def described(stored: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(doc_id, n_bytes, features) of every row, from stored files read back; files of equal lists are read once."""
    lists, chunks = stored
    prepare(lists.sparkSession)
    own, others = _apart(lists)
    nothing = F.lit(None).cast("array<struct<digest:binary,bytes:binary>>").alias("brought")
    alone = features(_put_together(own.select("*", nothing), ["doc_id", "n_bytes"]))
    of_lists = table(features(shared_files(lists, chunks)), "list-features")
    return alone.union(others.select("doc_id", "n_bytes", "list").join(of_lists, "list").drop("list").select(alone.columns))
