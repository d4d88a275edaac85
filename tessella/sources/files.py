"""Alignment files as tables: (aln_id, taxon_idx, taxon_id, seq), one row per taxon in the file's order.

Formats: fasta, nexus (interleaved or wrapped, with comments, matchchar; ntax and nchar are checked), phylip (sequential or
interleaved), clustal and stockholm. A taxon twice in a block raises; FASTA and PHYLIP keep such rows apart. A file is one
alignment, so a directory or a glob is many alignments at once. FASTA is read in splits, by as many tasks as a file has; a
file of another format is read whole by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: What ends a line, and what is blank, as classes of a pattern.
_ENDS, _BLANK = r"\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029", r"\s\x1C-\x1F"
SCHEMA = "aln_id string, taxon_idx int, taxon_id string, seq string"


def parse_nexus(text: str) -> list[tuple[str, str]]:
    plain, depth = [], 0
    for c in text:
        depth += c == "["
        if not depth:
            plain.append(c)
        depth -= c == "]" and depth > 0
    body = "".join(plain)
    if not body.lstrip().upper().startswith("#NEXUS"):
        raise ValueError("a NEXUS file starts with #NEXUS")
    form = re.search(r"(?is)\bformat\b(.*?);", body)
    same = re.search(r"(?i)matchchar\s*=\s*(\S)", form[1]) if form else None
    matrix = re.search(r"(?is)\bmatrix\b(.*?);", body)
    if not matrix:
        raise ValueError("a NEXUS file without a matrix")
    size = {k.lower(): int(n) for k, n in re.findall(r"(?i)\b(ntax|nchar)\s*=\s*(\d+)", body)}
    width = size.get("nchar")
    inter = bool(form and re.search(r"(?i)\binterleave(?!\s*=\s*no)\b", form[1]))
    rows: dict[str, str] = {}
    open_row = None
    for line in matrix[1].splitlines():
        if not line.strip():
            continue
        # Without interleaving a row goes on over lines until it has nchar characters.
        if open_row is not None and not inter and width and len(rows[open_row]) < width:
            rows[open_row] += "".join(line.split())
            continue
        m = re.match(r"\s*(?:'((?:[^']|'')*)'|(\S+))(?:\s+(.*\S))?\s*$", line)
        name = m[1].replace("''", "'") if m[1] is not None else m[2]
        if name in rows and (not inter or not width or len(rows[name]) >= width):
            raise ValueError(f"the taxon {name!r} occurs twice")
        rows[name] = rows.get(name, "") + "".join((m[3] or "").split())
        open_row = name
    if width and any(len(v) != width for v in rows.values()):
        raise ValueError("a NEXUS row of another length than nchar says")
    if "ntax" in size and len(rows) != size["ntax"]:
        raise ValueError("another number of NEXUS rows than ntax says")
    if same and rows:
        first = next(iter(rows.values()))
        rows = {k: "".join(f if c == same[1] else c for c, f in zip(v, first)) if len(v) == len(first) else v for k, v in rows.items()}
    return list(rows.items())


def parse_phylip(text: str) -> list[tuple[str, str]]:
    """Sequential if each row, read on over lines until it is full, gives the header's numbers; interleaved otherwise."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    taxa, width = map(int, lines[0].split()[:2])
    for rows in (_sequential(lines[1:], width), _interleaved(lines[1:], taxa)):
        if len(rows) == taxa and all(len(s) == width for _, s in rows):
            return rows
    raise ValueError("PHYLIP rows that do not have the numbers that the header says")


def _sequential(lines: list[str], width: int) -> list[tuple[str, str]]:
    rows: list[tuple[str, str]] = []
    for line in lines:
        if rows and len(rows[-1][1]) < width:
            rows[-1] = rows[-1][0], rows[-1][1] + "".join(line.split())
        else:
            name, _, rest = line.partition(" ")
            rows.append((name, "".join(rest.split())))
    return rows


def _interleaved(lines: list[str], taxa: int) -> list[tuple[str, str]]:
    rows = [(name, "".join(rest.split())) for name, _, rest in (x.partition(" ") for x in lines[:taxa])]
    for i, line in enumerate(lines[taxa:]):
        rows[i % taxa] = rows[i % taxa][0], rows[i % taxa][1] + "".join(line.split())
    return rows


def _blocks(blocks: list[list[str]]) -> list[tuple[str, str]]:
    """Rows of blocks of lines `name residues`, each name once a block."""
    rows: dict[str, str] = {}
    for block in blocks:
        seen = set()
        for line in block:
            name, residues = line.split()[:2]
            if name in seen:
                raise ValueError(f"the taxon {name!r} occurs twice")
            seen.add(name)
            rows[name] = rows.get(name, "") + residues
    return list(rows.items())


def _cut(text: str) -> list[list[str]]:
    """Blocks of lines that hold a row; lines that start with blank or a mark hold none."""
    out: list[list[str]] = [[]]
    for line in text.splitlines():
        if not line.strip():
            out.append([])
        elif not line[0].isspace() and not line.startswith("#") and len(line.split()) >= 2:
            out[-1].append(line)
    return out


def parse_clustal(text: str) -> list[tuple[str, str]]:
    return _blocks(_cut(text.partition("\n")[2]))


def parse_stockholm(text: str) -> list[tuple[str, str]]:
    return _blocks(_cut(text.partition("//")[0]))


#: Formats of whole files, with their parsers.
WHOLE = {"nexus": parse_nexus, "phylip": parse_phylip, "clustal": parse_clustal, "stockholm": parse_stockholm}
FORMATS = ["fasta", *WHOLE]


def read_alignment(spark: SparkSession, path: str, fmt: str = "fasta") -> DataFrame:
    """The alignments at path; aln_id is the file's path. Rows of unequal length in a file raise an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    if fmt == "fasta":
        return read_fasta(spark, path)
    parse = WHOLE[fmt]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["value"]):
                rows = parse(text)
                if len({len(s) for _, s in rows}) > 1:
                    raise ValueError(f"{name}: rows of unequal length")
                yield pd.DataFrame([(name, i, t, capital(s)) for i, (t, s) in enumerate(rows)], columns=["aln_id", "taxon_idx", "taxon_id", "seq"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    return files.mapInPandas(run, SCHEMA)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """The alignments of FASTA files at path, each split of a file read by a task of its own.

    Spark's text reader cuts a file where a line that starts with > follows another; a split that begins within a record goes on
    to the next one. A record's place in its file is the number of records in the splits before and its place in its split. The
    records are written once to the shared folder, so that places stay the same when executors go.

    Blank lines count for nothing, a file without a record has no row, text before the first record raises.
    """
    line = F.regexp_extract("text", f"^[^{_ENDS}]*", 0)
    parts = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("aln_id"), F.input_file_block_start().alias("split"), "value")
    # Lines may end in other ways too.
    cut = parts.select("aln_id", "split", F.explode(F.split("value", f"[{_ENDS}]>")).alias("text"))
    rows = cut.select("aln_id", "split", F.monotonically_increasing_id().alias("row"), line.alias("line"), F.regexp_replace(F.substr("text", F.length(line) + 1), f"(?U)[{_BLANK}]+", "").alias("seq"))
    rows = written(rows.withColumn("blank", ~F.col("line").rlike(f"(?U)[^{_BLANK}]") & (F.col("seq") == "")), "fasta")
    # One row a split. A file begins with > or with blank lines, which make a part that is no record.
    splits = rows.groupBy("aln_id", "split").agg(
        F.count("*").alias("n"), F.min("row").alias("first"), F.min_by(F.struct("blank", F.col("line").startswith(">").alias("marked")), "row").alias("head"), F.count_if("blank").alias("blanks"), F.min(F.when(~F.col("blank"), F.length("seq"))).alias("least"), F.max(F.when(~F.col("blank"), F.length("seq"))).alias("most")
    )
    file = Window.partitionBy("aln_id")
    head, none = F.min_by("head", "split").over(file), F.lit(0).cast("long")
    splits = splits.select("aln_id", "split", "first", F.coalesce(F.sum("n").over(file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), none).alias("before"), head.alias("head"), F.sum("blanks").over(file).alias("blanks"), F.min("least").over(file).alias("least"), F.max("most").over(file).alias("most"))
    empty = F.col("blanks") - F.col("head.blank").cast("long")
    fault = F.when(~F.col("head.blank") & ~F.col("head.marked"), ": a FASTA file starts with >").when((F.col("least") != F.col("most")) | (empty > 0) & (F.col("most") > 0), ": rows of unequal length")
    splits = splits.select("aln_id", "split", "first", "before", F.col("head.blank").alias("skips"), F.concat("aln_id", fault).alias("fault"))
    all_rows = rows.join(splits, ["aln_id", "split"]).withColumn("at", F.col("before") + F.col("row") - F.col("first"))
    own = F.when(F.col("at") == 0, F.substr("line", F.lit(2))).otherwise(F.col("line"))
    name = F.regexp_extract(own, f"(?U)^[{_BLANK}]*([^{_BLANK}]*)", 1)
    up = F.upper("seq")
    # A letter whose capital form is longer stays, so rows keep their length.
    each = F.array_join(F.transform(F.split("seq", ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")
    seq = F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault"))).when(F.length(up) == F.length("seq"), up).otherwise(each)
    return all_rows.filter(~((F.col("at") == 0) & F.col("skips"))).select("aln_id", (F.col("at") - F.col("skips").cast("long")).cast("int").alias("taxon_idx"), name.alias("taxon_id"), seq.alias("seq"))


def capital(s: str) -> str:
    """s in capitals, character by character: one whose capital form is longer stays, so rows keep their length."""
    up = s.upper()
    return up if len(up) == len(s) else "".join(c.upper() if len(c.upper()) == 1 else c for c in s)


def letters(taxa: DataFrame) -> DataFrame:
    """(aln_id, taxon_idx, taxon_id, col_idx, residue) of taxa."""
    return taxa.select("aln_id", "taxon_idx", "taxon_id", F.posexplode(F.split("seq", "")).alias("col_idx", "residue"))
