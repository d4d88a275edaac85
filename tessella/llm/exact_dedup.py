"""Exact deduplication by content-defined chunk recipes; DataFrame functions only.

A text is stripped of the six white-space characters, cut where its content says so, and described by its recipe: the
ordered list of its chunks' identifiers. Only recipes move between machines; text never does. A chunk is identified by
its SHA-256 digest, its length and an independent 64-bit hash, which must all agree. Chunks seen more than once get a
short identifier (their first occurrence), and documents are compared by the ordered lists of these. A document with a
chunk that occurs nowhere else has no copy, so it takes part in no comparison.

Defined results: a null text counts as empty, and empty texts form one group. Rows that share a doc_id are judged each by
its own text and come back once each. Of equal texts of equal length a null doc_id ranks after all others (a longer text
stays whatever its doc_id, so keep_id can be null), and of rows that are the same in both one is kept, any of them. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, table

#: The white space that equality ignores.
BLANK = r"[\x20\x09-\x0D]+"
#: A chunk ends at the first sentence mark after so many code points, or at the most code points.
LEAST, MOST = 1024, 8192


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    return rf"(?s).{{{least},{most - 1}}}?[.!?|;。]|.{{1,{most}}}"


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST, row: str | None = None) -> DataFrame:
    """(rid, doc_id, row, n_points, text_sha256, recipe): one row per row of docs, written to the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.col(row) if row else F.lit(None).cast("long")).alias("row"), F.length(text).alias("n_points"), F.regexp_replace(text, BLANK, "").alias("norm"))
    chunk = lambda c: F.struct(F.unhex(F.sha2(c.cast("binary"), 256)).alias("digest"), F.length(c).alias("len"), F.xxhash64(c).alias("check"))
    return table(
        base.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "row", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.transform(F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)), chunk).alias("recipe"),
        ),
        "recipes",
    )


def shared_chunks(occurrences: DataFrame) -> DataFrame:
    """(digest, len, check, chunk_id, n): the verified identifier of each chunk that occurs more than once."""
    return occurrences.groupBy("digest", "len", "check").agg(F.min(F.struct("rid", "pos")).alias("chunk_id"), F.count("*").alias("n")).filter("n > 1")


def exact_dedup(docs: DataFrame, least: int = LEAST, most: int = MOST, row: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs; with row (a column of docs) that too."""
    rec = recipes(docs, least, most, row)
    occ = rec.select("rid", F.posexplode("recipe").alias("pos", "c")).select("rid", "pos", "c.*")
    shared = table(shared_chunks(occ), "chunks")
    lists = (
        occ.join(shared.drop("n"), ["digest", "len", "check"], "left")
        .groupBy("rid")
        .agg(F.max(F.col("chunk_id").isNull()).alias("alone"), F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))).alias("ids"))
        .filter("not alone")
        .select("rid", F.col("ids.chunk_id").alias("ids"))
    )
    empty = rec.filter(F.size("recipe") == 0).select("rid", F.array().cast(lists.schema["ids"].dataType).alias("ids"))
    cand = table(lists.union(empty).join(rec.select("rid", "doc_id", "n_points", "text_sha256"), "rid"), "candidates")
    discard(shared)
    # The lists decide; that texts of equal lists have equal digests is only asserted.
    order = F.struct((-F.col("n_points")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    same = F.min("text_sha256") == F.max("text_sha256")
    size = F.when(same, F.count("*")).otherwise(F.raise_error(F.lit("texts of equal chunk lists differ")).cast("long"))
    groups = table(cand.groupBy("ids").agg(F.min(order).alias("best"), size.alias("group_size")).filter("group_size > 1").select("ids", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size"), "groups")
    found = table(cand.select("rid", "ids").join(groups, "ids").select("rid", "keep_id", "keep_rid", "group_size"), "found")
    discard(cand, groups)
    out = rec.select("rid", "doc_id", "row", "text_sha256").join(found, "rid", "left")
    alone = F.col("group_size").isNull()
    keep, kept = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), alone | (F.col("keep_rid") == F.col("rid"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *([F.col("row").alias(row)] if row else []))


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST, rid) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST, rid) = 1 AS kept,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(norm) AS text_sha256 FROM w
"""
