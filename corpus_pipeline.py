"""A corpus pipeline: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents, with what other columns docs has.

Decisions are about rows, not about values of doc_id: rows that share a doc_id are judged each by its own text, a row
without a doc_id like any other, and of rows that are the same in all columns one stays. A null text counts as empty; it
has no language, so the first stage takes it out. An empty table gives an empty result. Extra columns, whatever their
names, come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, language, packing, pii, simhash
from tessella.llm._common import read, table, with_rows
from tessella.llm.queries import vocabulary

#: No SQL expresses a learned language model, SimHash links, the tagger or the packing.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter (or null) go."""
    return language.keep_known(docs, language.fit(docs))


def _without(docs: DataFrame, row: str, judged: DataFrame, tag: str) -> DataFrame:
    """docs without the rows that judged (row, kept) does not keep."""
    gone = table(judged.filter("not kept").select(row), tag)
    return docs.join(gone, row, "left_anti").drop(row)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the one of the least doc_id (null last)."""
    keyed, row = with_rows(docs)
    return _without(keyed, row, exact_dedup.exact_dedup(keyed, row=row), "exact-gone").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id (null last) of each SimHash component stays."""
    keyed, row = with_rows(docs)
    return _without(keyed, row, simhash.simhash_dedup(keyed, row=row), "near-gone").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, each span of personal data in its text replaced by its kind; a null text stays null."""
    return pii.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row with their places in sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
