"""Alphabets of states and their detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States in the order of their codes, and characters that say nothing about the alphabet.
DNA = "ACGT"
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
IGNORED = "N-?X."


def code(residue: Column, alphabet: str) -> Column:
    """The state's place in the alphabet; -1 for gaps, ambiguity and anything else."""
    r = F.upper(residue)
    return F.when(F.length(r) == 1, F.coalesce(F.array_position(F.array(*map(F.lit, alphabet)), r), F.lit(0)).cast("int") - 1).otherwise(F.lit(-1))


def detect(letters: DataFrame) -> DataFrame:
    """(aln_id, is_dna, alphabet, n_states) from letters (aln_id, residue).

    An alignment of ignored characters only has a null alphabet. Anything that is not DNA counts as protein.
    """
    seen = letters.select("aln_id", F.upper("residue").alias("r"))
    real = F.when(~F.col("r").isin(*IGNORED) & (F.length("r") == 1), F.col("r"))
    got = seen.groupBy("aln_id").agg(F.collect_set(real).alias("states"))
    dna = F.size(F.array_except("states", F.array(*map(F.lit, DNA)))) == 0
    some = F.size("states") > 0
    return got.select("aln_id", F.when(some, dna).alias("is_dna"), F.when(some, F.when(dna, F.lit(DNA)).otherwise(F.lit(PROTEIN))).alias("alphabet"), F.size("states").cast("long").alias("n_states"))
