"""Sinks: rebuilt sequences, FASTA text, score and prune-log tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import fields, write_lines

#: Headers of the report files.
SCORE_HEADER = ["Row", "Empirical-Pvalue", "Z-Score"]
CHANGE_HEADER = ["Row", "Before-Z", "Before-Pvalue", "After-Z", "After-Pvalue", "Delta-Z"]
LOG_HEADER = ["Iteration", "Original Index", "Global ChiScore", "Initial Significant ChiScore", "ChiScore Difference", "Significant taxa", "Null-Pvalue", "Algorithm"]


def sequences(letters: DataFrame) -> DataFrame:
    """(aln_id, taxon_id, seq), with taxon_idx where letters (aln_id, [taxon_idx,] taxon_id, col_idx, residue) have it;
    then taxa of the same id stay apart."""
    one = F.when(F.length("residue") == 1, F.col("residue")).otherwise("-")  # a capital of two letters is no state
    ordered = F.array_sort(F.collect_list(F.struct("col_idx", one.alias("residue"))))
    by = [c for c in ("aln_id", "taxon_idx", "taxon_id") if c in letters.columns]
    return letters.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["residue"]), "").alias("seq"))


def fasta(seqs: DataFrame, width: int = 60) -> DataFrame:
    """seqs with fasta: the record's text, lines wrapped at width."""
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return seqs.withColumn("fasta", F.concat(F.lit(">"), F.col("taxon_id").cast("string"), F.lit("\n"), body))


def _tsv(rows: DataFrame, path: str, header: list[str], columns, order: list[str]) -> str:
    return write_lines(rows.withColumn("line", fields(columns)), path, order, "\t".join(header))


def write_fasta(seqs: DataFrame, path: str) -> str:
    """One file of seqs (seq as order, taxon_id, text) of one alignment."""
    records = fasta(seqs.select(F.col("seq").alias("at"), "taxon_id", F.col("text").alias("seq")))
    return write_lines(records.select("at", F.col("fasta").alias("line")), path, ["at"])


def write_scores(scores: DataFrame, path: str) -> str:
    """(taxon_id, p, z), strongest first; p with four decimals, z with two."""
    strong = scores.withColumn("by", -F.abs("z"))
    return _tsv(strong, path, SCORE_HEADER, [F.col("taxon_id"), F.format_string("%.4f", "p"), F.format_string("%.2f", "z")], ["by", "taxon_idx"])


def write_log(log: DataFrame, path: str) -> str:
    """A prune's log, in order of removal."""
    columns = ["iteration", "original_index", "global_chi2", "initial_score", "delta", "significant_taxa", "null_p", "algorithm"]
    return _tsv(log, path, LOG_HEADER, [F.col(c) for c in columns], ["seq"])


def write_changes(scores: DataFrame, path: str) -> str:
    """Scores before and after, the highest before first."""
    columns = ["taxon_id", "before_z", "before_p", "after_z", "after_p", "delta_z"]
    return _tsv(scores.withColumn("by", -F.col("before_z")), path, CHANGE_HEADER, [F.col(c) for c in columns], ["by", "seq"])


def write_score_json(rows: DataFrame, path: str, algorithm: str, version: str) -> str:
    """The score JSON of one alignment's prune rows, a line for each vector and each taxon."""
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    order = {"schema_version": F.lit("3"), "version": text(F.lit(version)), "algorithm": text(F.lit(algorithm)), "stop_reason": text(F.col("text")), "null_recomputes": F.col("iteration").cast("string")}
    end = rows.filter("kind = 'summary'")
    parts = [end.select(F.lit(0).alias("part"), F.lit(i).cast("long").alias("at"), F.concat(F.lit("{" if i == 0 else ""), F.lit(f'"{k}": '), v, F.lit(",")).alias("line")) for i, (k, v) in enumerate(order.items())]

    def listed(kind: str, part: int, values: DataFrame, name: str, whole: bool, last: str = ",") -> DataFrame:
        """Lines of a list: each element on its own, or one element that is the list."""
        if whole:
            return values.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("at"), F.concat(F.lit(f'"{name}": '), F.col("v"), F.lit(last)).alias("line"))
        n = values.agg(F.max("seq").alias("n"))
        body = values.crossJoin(F.broadcast(n)).select(F.lit(part).alias("part"), F.col("seq").alias("at"), F.concat(F.when(F.col("seq") == 0, f'"{name}": [').otherwise(""), F.col("v"), F.when(F.col("seq") == F.col("n"), "]" + last).otherwise(",")).alias("line"))
        return body

    vector = rows.filter("values IS NOT NULL").select("kind", "seq", F.to_json("values").alias("v"))
    parts.append(listed("score", 1, rows.filter("kind = 'score'").select("seq", text(F.col("taxon_id")).alias("v")), "taxa", False))
    for part, (kind, whole) in enumerate((("before_real", True), ("after_real", True), ("before_permuted", False)), 2):
        parts.append(listed(kind, part, vector.filter(F.col("kind") == kind), kind, whole))
    deep = end.select(F.lit(1).alias("one")).join(vector.filter("kind = 'null_max_deltas'").select(F.lit(1).alias("one"), "v"), "one", "left").select(F.coalesce("v", F.lit("null")).alias("v"))
    parts.append(listed("null_max_deltas", 5, deep, "null_max_deltas", True, "}"))
    return write_lines(reduce(DataFrame.unionByName, parts), path, ["part", "at"])


#: What the score JSON of pruning holds, as a schema.
JSON_SCHEMA = "schema_version int, version string, algorithm string, stop_reason string, null_recomputes int, taxa array<string>, before_real array<double>, after_real array<double>, before_permuted array<array<double>>, null_max_deltas array<double>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per score JSON at path (a file, a directory or a glob)."""
    return spark.read.schema(JSON_SCHEMA).json(path, multiLine=True)


def distributions(scores: DataFrame) -> DataFrame:
    """(kind, chi2) of score JSON rows: the values whose densities are compared, long form."""
    kinds = {"before_real": F.col("before_real"), "after_real": F.col("after_real"), "before_permuted": F.flatten("before_permuted")}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("values")) for k, v in kinds.items()])
    return scores.select(F.explode(each).alias("e")).select("e.kind", F.explode("e.values").alias("chi2"))
