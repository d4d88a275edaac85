"""Best-fit packing of tokenised documents into sequences, bulk-synchronous.

Documents become pieces of at most `size` tokens; only longer documents are cut, into pieces of `size` and a rest. As many
sequences are opened as the pieces need at least, and a sequence's free space is a gap. In a superstep, units (pieces, or
runs of short ones) and gaps are range-sorted together and swept in parallel: each gap takes the longest unit that fits
and that no smaller gap takes, so a unit's gap is its successor among those that are free. What a range leaves is matched
across ranges by its depth on the sweep's stack; units of equal length go by rank. So a superstep's matches are the same
however the rows are partitioned. Then the gaps shrink, and the next superstep follows.

Short pieces go in runs of up to size / UNIT tokens, of similar lengths, or a gap would need a superstep for each. Runs that
fit nowhere any more are halved, down to single pieces. When no piece fits, those left are ranked anew and new sequences are
opened for them, again as few as they need at least. Nothing is held or decided on the driver but counts for each range
of about ROWS rows, whose number it uses as offsets, and a few totals of each superstep.

Defined results: a null text counts as empty (one token, the end mark). Added tokens that a text spells out are encoded
as the library does, as themselves. Rows that share a doc_id are separate documents
and come back once each. A null doc_id is packed too. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import batches_of, discard, kept, prepare, table

SIZE, END, CACHE = 4096, 1, 500_000
#: Rows of a range, about; runs of short pieces have up to size / UNIT tokens; a superstep that places less than one in
#: SLOW of what it could ends its kind of unit.
ROWS, UNIT, SLOW = 100_000, 64, 20
LEFT, SPARE, PAIR = 0, 1, 2
#: A unit's id is the rank of its first piece, cum the tokens of all pieces before that, lens its pieces' lengths. A gap has
#: its sequence's number as id.
_STATE = pa.schema([("value", pa.int64()), ("gap", pa.bool_()), ("id", pa.int64()), ("cum", pa.int64()), ("lens", pa.list_(pa.int32()))])
_SWEPT = ["part", "place", "kind", "id", "cum", "length", "sid", "free", "lens"]
_BLANK, _SEPARATOR = re.compile(r"[ \t-\r]+"), re.compile(r"[\x1c-\x1f]")
#: Characters that normal form C and lower-casing treat one by one, and that no space class has.
_PLAIN = re.compile(r"[!-~\u00a1-\u00ac\u00ae-\u00ff]*")
_WORD_END = b"\xff"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE_OF = _byte_letters()


class Encoder:
    """Ids of a text by a tokenizers file (lower-casing BPE with word ends), word by word; words are remembered.

    A run of characters between white space is encoded by itself. Runs of ASCII and Latin-1 letters take the fast way:
    the file's merges as byte ranks for tiktoken, with a byte that UTF-8 never has as the word end. That gives the
    library's ids if every entry of the vocabulary encodes to itself, which is tested. Other runs go to the library.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.core = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        # Added tokens are cut out of the raw text first, wherever they stand.
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        if any(x[k] for x in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens of this kind are not supported")
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.ids = {t: array("I", [i]).tobytes() for t, i in added.items()}
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        ranks = {}
        for token, i in file["model"]["vocab"].items():
            raw = bytes(_BYTE_OF[c] for c in token.removesuffix("</w>"))
            ranks[raw + _WORD_END if token.endswith("</w>") else raw] = i
        # The word end's own byte is no entry of use; it takes the place of the byte that UTF-8 lacks.
        self.merges = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Encoder:
        loaded = kept("packing")
        if path not in loaded:
            loaded[path] = cls(path)
        return loaded[path]

    def word(self, w: str) -> bytes:
        """Ids of a run of characters without white space."""
        low = w.lower()
        if low.isalpha() and _PLAIN.fullmatch(low):
            ids = self.merges(low.encode("utf-8") + _WORD_END)
        elif _PLAIN.fullmatch(low):
            ids = [i for p in self.pattern.findall(low) for i in self.merges(p.encode("utf-8") + _WORD_END)]
        else:
            ids = self.core.encode(w, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self.plain(text[at : m.start()]), self.ids[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])]) if out else self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        # str.split also cuts at four separators that are no white space to the tokenizer.
        words = text.split() if not _SEPARATOR.search(text) else _BLANK.split(text)
        found = [*map(self.known.get, words)]
        if None in found:
            known, word = self.known, self.word
            if len(known) > CACHE:
                known.clear()
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    if (x := known.get(w)) is None:
                        x = word(w)
                        if len(w) <= 64:
                            known[w] = x
                    found[i] = x
        return b"".join(found)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, tokens: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of docs; with tokens also ids, as bytes."""
    prepare(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if tokens else "")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        mark = int(end).to_bytes(4, "little")
        for b in batches_of(batches):
            rows: list[tuple] = []
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.encode(x.as_py() or "") + mark
                n = len(ids) // 4
                for i, at in enumerate(range(0, n, size)):
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((d, i, at, len(part) // 4, zlib.crc32(part), part))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in zip(range(len(names)), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def sweep(is_gap: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(units taken, gaps that take them, gaps left, units left), as places, of a range sorted by rising value.

    Units wait on a stack, so a gap takes the longest that fits and is not taken by a smaller gap.
    """
    waiting: list[int] = []
    taken, takers, spare = [], [], []
    for i, gap in enumerate(is_gap):
        if not gap:
            waiting.append(i)
        elif waiting:
            taken.append(waiting.pop())
            takers.append(i)
        else:
            spare.append(i)
    return taken, takers, spare, waiting


def swept(state: DataFrame, ranges: int) -> DataFrame:
    """state (value, gap, id, cum, lens) in ranges by (value, gap, id), each swept by itself.

    Rows (part, place, kind, id, cum, length, sid, free, lens): kind LEFT is a unit and SPARE a gap without a match, in
    order of place; PAIR is both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches([*batches], _STATE)  # one range, about ROWS rows
        value, ids, cum = (rows[c].to_numpy() for c in ("value", "id", "cum"))
        taken, takers, spare, left = (np.array(x, np.int64) for x in sweep(rows["gap"].to_pylist()))
        # A unit without a gap takes its own place as one, and a gap without a unit likewise; kind tells what counts.
        unit, gap = np.concatenate([taken, left, spare]), np.concatenate([takers, left, spare])
        kind = np.repeat([PAIR, LEFT, SPARE], [len(taken), len(left), len(spare)])
        place = np.concatenate([np.arange(len(x)) for x in (taken, left, spare)])
        columns = [np.full(len(unit), TaskContext.get().partitionId()), place, kind, ids[unit], cum[unit], value[unit], ids[gap], value[gap]]
        lens = rows["lens"].combine_chunks().take(pa.array(unit)) if len(unit) else pa.array([], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in columns), lens], _SWEPT)

    ordered = state.repartitionByRange(ranges, "value", "gap", "id").sortWithinPartitions("value", "gap", "id")
    return ordered.select(_STATE.names).mapInArrow(run, ", ".join(f"{c} long" for c in _SWEPT[:-1]) + ", lens array<int>")


def stitched(parts: DataFrame) -> DataFrame:
    """swept() with the matches across ranges.

    The units that a range leaves wait for gaps of later ranges, the last first: the stack's depth before each range
    follows from the ranges' counts, and a gap's unit is the latest one at the gap's depth. A depth has at most two rows
    of each range.
    """
    counts: dict[int, dict[int, int]] = {}
    for r in parts.filter(F.col("kind") != PAIR).groupBy("part", "kind").count().collect():  # two rows a range
        counts.setdefault(r["part"], {})[r["kind"]] = r["count"]
    rows, depth = [], 0
    for p in sorted(counts):
        after = max(depth - counts[p].get(SPARE, 0), 0)
        rows.append((p, depth, after))
        depth = after + counts[p].get(LEFT, 0)
    depths = parts.sparkSession.createDataFrame(rows or [(-1, 0, 0)], "part long, before long, after long")
    level = F.when(F.col("kind") == SPARE, F.col("before") - F.col("place")).otherwise(F.col("after") + F.col("place") + 1)
    rest = parts.filter(F.col("kind") != PAIR).join(F.broadcast(depths), "part").withColumn("level", level).select("level", *_SWEPT)
    same = Window.partitionBy("level").orderBy("part", F.col("kind").desc())
    unit = F.lag(F.struct("kind", "id", "cum", "length", "lens")).over(same)
    deep = rest.filter("level > 0").select("*", unit.alias("unit"), F.lead("kind").over(same).alias("next"))
    meets = (F.col("kind") == SPARE) & F.coalesce(F.col("unit.kind") == LEFT, F.lit(False))
    deep = deep.filter((F.col("kind") == SPARE) | F.col("next").isNull() | (F.col("next") != SPARE))
    of = [F.when(meets, F.col(f"unit.{c}")).otherwise(F.col(c)).alias(c) for c in ("id", "cum", "length", "lens")]
    deep = deep.select("part", "place", F.when(meets, PAIR).otherwise(F.col("kind")).cast("long").alias("kind"), *of, "sid", "free").select(_SWEPT)
    return parts.filter(F.col("kind") == PAIR).union(deep).union(rest.filter("level <= 0").select(_SWEPT))


def ranked(parts: DataFrame, total: int) -> DataFrame:
    """parts with g, its rank by falling length, and cum, the tokens of all before it; written."""
    names = [*parts.columns, "part", "g", "cum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, tokens = 0, 0
        for b in batches:
            length = b.column("length").to_numpy()
            past = np.cumsum(length)
            new = [np.full(len(length), TaskContext.get().partitionId(), np.int64), n + np.arange(len(length)), tokens + past - length]
            n, tokens = n + len(length), tokens + int(length.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, new)], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", part long, g long, cum long"
    order = [F.col("length").desc(), F.col("rid")]
    local = table(parts.repartitionByRange(-(-total // ROWS), *order).sortWithinPartitions(*order).mapInArrow(run, schema), "ranges")
    sums = local.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).orderBy("part").collect()  # a row a range
    rows, n, tokens = [], 0, 0
    for r in sums:
        rows.append((r["part"], n, tokens))
        n, tokens = n + r["n"], tokens + r["tokens"]
    before = parts.sparkSession.createDataFrame(rows, "part long, n long, tokens long")
    return local.join(F.broadcast(before), "part").withColumns({"g": F.col("g") + F.col("n"), "cum": F.col("cum") + F.col("tokens")}).drop("part", "n", "tokens")


def bundles(numbered: DataFrame, most: int) -> DataFrame:
    """Units (id, cum, lens): runs of pieces of one band of lengths, up to `most` tokens, in order of rank."""
    bits = F.ceil(F.log2("length")).cast("int")
    starts = {r["band"]: r["g"] for r in numbered.groupBy(bits.alias("band")).agg(F.min("g").alias("g")).collect()}  # a row a band
    start, wide = F.lit(None).cast("long"), F.lit(1).cast("long")
    for band, g in starts.items():
        start = F.when(bits == band, F.lit(g)).otherwise(start)
        wide = F.when(bits == band, F.lit(max(1, most >> band))).otherwise(wide)
    first = start + F.floor((F.col("g") - start) / wide) * wide
    lens = F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False)  # at most `most` of them
    return numbered.groupBy(first.cast("long").alias("id")).agg(F.min("cum").alias("cum"), lens.alias("lens"))


def tokens_of(lens: str):
    return F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x)


def halves(units: DataFrame) -> DataFrame:
    """units, those of several pieces cut in the middle."""
    w = F.floor(F.size("lens") / 2).cast("int")
    cut = units.withColumns({"front": F.slice("lens", F.lit(1), w), "back": F.slice("lens", w + 1, F.size("lens"))})
    one = F.struct("id", "cum", F.col("front").alias("lens"))
    two = F.struct((F.col("id") + F.size("front")).alias("id"), (F.col("cum") + tokens_of("front")).alias("cum"), F.col("back").alias("lens"))
    return cut.select(F.explode(F.filter(F.array(one, two), lambda u: F.size(u["lens"]) > 0)).alias("u")).select("u.*")


def finish(units: list[tuple], gaps: list[tuple[int, int]], size: int, least: int, opened: int) -> Iterator[tuple[int, int, int]]:
    """(rank, sequence, offset) of every piece of units (first rank, lens): the supersteps of fill() and turns of placed(),
    by the same rules, on what fits one range. gaps are (free, sequence)."""
    runs = [(sum(n), g, [*zip(range(g, g + len(n)), n)]) for g, n in units]
    while runs:
        rows = sorted([*((n, False, g, x) for n, g, x in runs), *((f, True, q, None) for f, q in gaps)], key=lambda r: r[:3])
        taken, takers, spare, left = sweep([r[1] for r in rows])
        gaps = [(rows[i][0], rows[i][2]) for i in spare]
        for u, i in zip(taken, takers):
            free, q = rows[i][0], rows[i][2]
            for g, n in rows[u][3]:
                yield g, q, size - free
                free -= n
            gaps.append((free, q))
        gaps = [x for x in gaps if x[0] >= least]
        runs = [(rows[i][0], rows[i][2], rows[i][3]) for i in left]
        if not runs:
            return
        more = ended = False
        if not gaps:
            ended = True
        else:
            stuck = max(gaps)[0] < min(runs)[0]
            if max(len(x) for *_, x in runs) > 1:
                if stuck or SLOW * len(taken) < min(len(runs), len(gaps)):
                    parts = [p for *_, x in runs for p in ((x[: len(x) // 2], x[len(x) // 2 :]) if len(x) > 1 else (x,))]
                    runs = [(sum(n for _, n in x), x[0][0], x) for x in parts]
            elif stuck or SLOW * len(taken) < len(runs):
                ended, more = True, not stuck and bool(taken)
        if ended:
            todo = sorted(p for *_, x in runs for p in x)
            if not more:
                new = max(sum(2 * n > size for _, n in todo), -(-sum(n for _, n in todo) // size))
                gaps += [(size, q) for q in range(opened, opened + new)]
                opened += new
            least, runs, i = todo[-1][1], [], 0
            while i < len(todo):
                band = (todo[i][1] - 1).bit_length()
                j = i + 1
                while j < len(todo) and j < i + (size // UNIT >> band) and (todo[j][1] - 1).bit_length() == band:
                    j += 1
                runs.append((sum(n for _, n in todo[i:j]), todo[i][0], todo[i:j]))
                i = j


def finished(state: DataFrame, size: int, least: int, opened: int) -> DataFrame:
    """finish() in one task: (id, width, cum, sid, offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches], _STATE).to_pylist()  # at most ROWS rows
        done = [*finish([(r["id"], r["lens"]) for r in rows if not r["gap"]], [(r["value"], r["id"]) for r in rows if r["gap"]], size, least, opened)]
        g, q, at = (pa.array([r[i] for r in done], pa.int64()) for i in range(3))
        yield pa.RecordBatch.from_arrays([g, pa.array([1] * len(done), pa.int64()), pa.nulls(len(done), pa.int64()), q, at], ["id", "width", "cum", "sid", "offset"])

    return state.select(_STATE.names).coalesce(1).mapInArrow(run, "id long, width long, cum long, sid long, offset long")


def _members(units: DataFrame, numbered: DataFrame, *more: str) -> DataFrame:
    """The pieces of units (id, width, cum), with the columns `more` and at, the tokens of the unit before the piece."""
    each = units.select(F.explode(F.expr("sequence(id, id + width - 1)")).alias("g"), F.col("cum").alias("from"), *more)
    return numbered.join(each, "g").withColumn("at", F.coalesce(F.col("cum") - F.col("from"), F.lit(0)))


def fill(numbered: DataFrame, gaps: DataFrame, size: int, least: int, opened: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, bool]:
    """Supersteps until no gap can take more: (placed units, gaps, units left or None, whether more might fit).

    As soon as units and gaps fit one range, the supersteps that are left run to their end in one task.
    """
    units, placed, width = bundles(numbered, size // UNIT), [], F.size("lens").cast("long").alias("width")
    while True:
        unit = units.select(tokens_of("lens").alias("value"), F.lit(False).alias("gap"), "id", "cum", "lens")
        free = gaps.select(F.col("free").alias("value"), F.lit(True).alias("gap"), F.col("sid").alias("id"), F.lit(0).cast("long").alias("cum"), F.lit(None).cast("array<int>").alias("lens"))
        state = table(unit.union(free), "state")
        rows = state.count()
        if rows <= ROWS:
            placed.append(table(finished(state, size, least, opened), "finished"))
            gaps, left, more = None, None, False
            discard(state)
            break
        ranges = -(-rows // ROWS)
        parts = table(swept(state, ranges), "swept")
        now = table(stitched(parts), "stitched")
        discard(state, parts)
        units = now.filter(F.col("kind") == LEFT).select("id", "cum", "lens")
        pair, unmatched = F.col("kind") == PAIR, F.col("kind") == LEFT
        room = F.when(pair, F.col("free") - F.col("length")).otherwise(F.col("free"))
        gaps = now.filter(F.col("kind") != LEFT).select("sid", room.alias("free")).filter(F.col("free") >= least)
        placed.append(now.filter(pair).select("id", width, "cum", "sid", (size - F.col("free")).alias("offset")))
        s = now.agg(F.count(F.when(unmatched, 1)).alias("units"), F.count(F.when(pair, 1)).alias("pairs"), F.max(F.when(unmatched, F.size("lens"))).alias("widest"), F.min(F.when(unmatched, F.col("length"))).alias("shortest"), F.max(F.when(~unmatched, room)).alias("room"), F.count(F.when(~unmatched & (room >= least), 1)).alias("gaps")).first()
        left, more = (units if s["units"] else None), False
        if not s["units"] or not s["gaps"]:
            break
        stuck = s["room"] < s["shortest"]
        if s["widest"] > 1:
            if stuck or SLOW * s["pairs"] < min(s["units"], s["gaps"]):
                units = halves(units)
        elif stuck or SLOW * s["pairs"] < s["units"]:
            more = not stuck and s["pairs"] > 0
            break
    done = placed[0]
    for x in placed[1:]:
        done = done.union(x)
    return done, gaps, left, more


def placed(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """parts (rid, length and others) with sequence_id and offset; rid differs in every row, length is from 1 to size."""
    spark, todo, gaps, opened, more, out = parts.sparkSession, parts, None, 0, False, None
    while True:
        s = todo.agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.count(F.when(F.col("length") * 2 > size, 1)).alias("long"), F.min("length").alias("least")).first()
        if not s["n"]:
            return parts.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        numbered = ranked(todo, s["n"])
        # As few new sequences as these pieces can do with; what they can't take opens more in the next turn.
        new = 0 if more else max(s["long"], -(-s["tokens"] // size))
        fresh = spark.range(opened, opened + new).select(F.col("id").alias("sid"), F.lit(size).cast("long").alias("free"))
        opened += new
        units, gaps, left, more = fill(numbered, fresh if gaps is None else gaps.union(fresh), size, s["least"], opened)
        done = _members(units, numbered, "sid", "offset").select(*parts.columns, F.col("sid").alias("sequence_id"), (F.col("offset") + F.col("at")).alias("offset"))
        out = done if out is None else out.union(done)
        if left is None:
            return out
        todo = table(_members(left.select("id", F.size("lens").alias("width"), "cum"), numbered).select(parts.columns), "left")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, tokens: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece; with tokens also ids, as bytes."""
    # Written once, so a piece's number is the same wherever it is read; pieces that are alike in all else differ in it.
    parts = table(pieces(docs, tokenizer, size, end, tokens).select(F.monotonically_increasing_id().alias("rid"), "*"), "pieces")
    out = placed(parts.drop("ids"), size)
    if tokens:
        out = out.join(parts.select("rid", "ids"), "rid")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if tokens else []))
