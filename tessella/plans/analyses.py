"""The two analyses: the composition test and pruning, for every alignment of a table at once.

Both are tables and joins all through; pruning is the loop of plans.pruning, whose results become the rows of its reports.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, PROTEIN, code, detect
from ..operators import composition as comp
from ..operators import delta as site_delta
from ..operators import null as nulls
from ..operators import tiles as tile
from ..sources.files import letters
from ..sources.shared import written
from . import pruning
from .pruning import ALGORITHMS

PRUNE_SCHEMA = "aln_id string, kind string, seq long, iteration int, original_index int, global_chi2 double, initial_score double, delta double, significant_taxa int, null_p double, algorithm string, taxon_id string, before_z double, before_p double, after_z double, after_p double, delta_z double, text string, values array<double>"
KINDS = ("log", "score", "sequence", "summary", "before_real", "after_real", "before_permuted", "null_max_deltas")


def alphabets(taxa: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """Tiles of taxa's alignments (aln_id, taxon_idx, seq), those of each alphabet on their own, and its number of states."""
    cut = letters(taxa)
    found = written(detect(cut.select("aln_id", "residue")).select("aln_id", "alphabet"), "alphabets")
    if (bare := found.filter("alphabet IS NULL").first()) is not None:
        raise ValueError(f"{bare['aln_id']}: no state to tell the alphabet from")
    for alphabet in (DNA, PROTEIN):
        kind = found.filter(F.col("alphabet") == alphabet).select("aln_id")
        if kind.take(1):
            own = cut.join(kind, "aln_id", "left_semi").select("aln_id", "taxon_idx", "col_idx", code(F.col("residue"), alphabet).alias("code"))
            yield tile.tiles(own, len(alphabet)), len(alphabet)


def composition_test(taxa: DataFrame, permutations: int = 100, seed: int = nulls.SEED) -> DataFrame:
    """(aln_id, taxon_idx, taxon_id, chi2, p, z, biased) of taxa (aln_id, taxon_idx, taxon_id, seq)."""
    parts = []
    for made, n in alphabets(taxa):
        chi2 = written(comp.chi2_of(tile.margins(made, n), n), "observed")
        parts.append(nulls.taxon_scores(chi2, nulls.null_chi2(made, n, permutations, seed)))
    return reduce(DataFrame.union, parts).join(taxa.select("aln_id", "taxon_idx", "taxon_id"), ["aln_id", "taxon_idx"])


def one_batch(made: DataFrame, n_states: int, top_n: int, permutations: int = 100, seed: int = nulls.SEED) -> DataFrame:
    """(aln_id, rank, col_idx, delta, p, global_chi2, initial_score, significant_taxa): the first batch of the squared
    pruning of tiles, with the scores after it."""
    chi2, null = comp.chi2_of(tile.margins(made, n_states), n_states), nulls.null_chi2(made, n_states, permutations, seed)
    biased = nulls.empirical_p_alignment(chi2, null).filter(F.col("p") <= 0.95).select("aln_id", F.col("global_chi2").alias("initial_score"))
    top = site_delta.top_sites(site_delta.site_deltas(made, n_states), top_n)
    batch = written(site_delta.justified(top, site_delta.delta_null(made, n_states, permutations, seed + permutations)).join(biased, "aln_id"), "batch")
    after = comp.chi2_of(tile.margins(tile.without(made, batch), n_states), n_states)
    end = after.join(nulls.threshold(chi2, null), "aln_id").groupBy("aln_id").agg(F.sum("chi2").alias("global_chi2"), F.count_if(F.col("chi2") > F.col("tau")).alias("significant_taxa"))
    return batch.join(end, "aln_id")


def prune(taxa: DataFrame, algorithm: str = "wasserstein", max_residue_pruned: int | None = 100, permutations: int = 100, top_n: int = 1, delta_null: bool = True, recomputes: int | None = 1, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Prune every alignment of taxa (aln_id, taxon_idx, taxon_id, seq); rows of kind log, score, sequence
    and summary, and the vectors before_real, after_real, before_permuted (a row a permutation) and null_max_deltas.
    Rows of other kinds than those asked for are not worked out. Without a max_residue_pruned (None) it goes on until the
    alignment or its best site is no longer significant, or no column is left.

    The sequences are written, as several steps read them, each side by side."""
    s = pruning.Settings(algorithm, max_residue_pruned, permutations, top_n, delta_null, recomputes)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {', '.join(ALGORITHMS)}")
    parts = []
    taxa = written(taxa.select("aln_id", "taxon_idx", "taxon_id", "seq").repartition(tile.DEALT, "aln_id", "taxon_idx"), "sequences")
    for made, n in alphabets(taxa):
        # The null's pool has permutations x taxa scores; small pools have fewer quantiles. MOST_QUANTILES groups at most.
        k = F.least(F.lit(pruning.MOST_QUANTILES), F.col("total_taxa") * permutations)
        for r in made.select(k.alias("k")).distinct().collect():
            own = made.filter(k == r["k"])
            parts.append(_rows(taxa.join(own.select("aln_id").distinct(), "aln_id", "left_semi"), pruning.prune_tiles(own, n, s, r["k"]), algorithm, kinds))
    return reduce(DataFrame.unionByName, parts)


def scores(got: pruning.Pruned) -> DataFrame:
    """(aln_id, taxon_idx, before_z, before_p, after_z, after_p, delta_z), against the first null."""
    by = ["aln_id", "taxon_idx"]
    sides = []
    for name, chi2 in (("before", got.before), ("after", got.after)):
        both = nulls.empirical_p_taxon(chi2, got.null).join(nulls.robust_z(chi2, got.null), by)
        sides.append(both.select(*by, F.col("z").alias(f"{name}_z"), F.col("p").alias(f"{name}_p")))
    return sides[0].join(sides[1], by).withColumn("delta_z", F.col("after_z") - F.col("before_z"))


def run_summary(rows: DataFrame) -> DataFrame:
    """(aln_id, chi2_before, p_before, chi2_after, p_after, null_least, null_most, z_before, z_after, removed, biased_after,
    recomputes, reason) of prune's rows; p against the first null."""
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    of = lambda k: F.col("kind") == k
    sides = rows.filter("kind IN ('before_real', 'after_real')").groupBy("aln_id").agg(F.max(F.when(of("before_real"), total)).alias("chi2_before"), F.max(F.when(of("after_real"), total)).alias("chi2_after"))
    drawn = rows.filter(of("before_permuted")).select("aln_id", total.alias("drawn")).join(sides, "aln_id")
    at_least = lambda c: F.avg(F.when(F.col("drawn") >= F.col(c), 1.0).otherwise(0.0))
    null = drawn.groupBy("aln_id", "chi2_before", "chi2_after").agg(at_least("chi2_before").alias("p_before"), at_least("chi2_after").alias("p_after"), F.min("drawn").alias("null_least"), F.max("drawn").alias("null_most"))
    rest = rows.groupBy("aln_id").agg(
        F.max(F.abs(F.when(of("score"), F.col("before_z")))).alias("z_before"), F.max(F.abs(F.when(of("score"), F.col("after_z")))).alias("z_after"), F.count_if(of("log")).alias("removed"),
        F.max(F.when(of("summary"), F.col("significant_taxa"))).alias("biased_after"), F.max(F.when(of("summary"), F.col("iteration"))).alias("recomputes"), F.max(F.when(of("summary"), F.col("text"))).alias("reason"),
    )
    return null.join(rest, "aln_id")


def _rows(taxa: DataFrame, got: pruning.Pruned, algorithm: str, kinds: tuple[str, ...]) -> DataFrame:
    """A prune's results of the kinds asked for as rows of PRUNE_SCHEMA."""
    columns = [c.split() for c in PRUNE_SCHEMA.split(", ")]

    def shaped(df: DataFrame, kind: str) -> DataFrame:
        df = df.withColumn("kind", F.lit(kind))
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])

    log = got.log.select("aln_id", "seq", F.col("turn").alias("iteration"), F.col("col_idx").alias("original_index"), "global_chi2", F.col("score").alias("initial_score"), "delta", F.col("biased").alias("significant_taxa"), F.col("p").alias("null_p"), F.lit(algorithm).alias("algorithm"))

    def score() -> DataFrame:
        return scores(got).join(taxa.select("aln_id", "taxon_idx", "taxon_id"), ["aln_id", "taxon_idx"]).withColumn("seq", F.col("taxon_idx"))

    def end() -> DataFrame:
        left = got.after.join(nulls.threshold(got.before, got.null), "aln_id").groupBy("aln_id").agg(F.count_if(F.col("chi2") > F.col("tau")).alias("significant_taxa"))
        return got.ends.join(left, "aln_id").select("aln_id", F.lit(0).alias("seq"), F.col("reason").alias("text"), F.col("used").alias("iteration"), "significant_taxa")

    gone = got.removed.groupBy("aln_id").agg(F.collect_set("col_idx").alias("gone"))
    kept = F.filter(F.split("seq", ""), lambda c, i: ~F.array_contains("gone", i))
    sequence = taxa.join(gone, "aln_id", "left").select("aln_id", F.col("taxon_idx").alias("seq_"), "taxon_id", F.when(F.col("gone").isNull(), F.col("seq")).otherwise(F.array_join(kept, "")).alias("text")).withColumnRenamed("seq_", "seq")
    vector = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c])

    def chi2_of(chi2: DataFrame, *by: str) -> DataFrame:
        return chi2.withColumn("at", F.col("taxon_idx")).groupBy("aln_id", *by).agg(vector("chi2").alias("values")).withColumn("seq", F.col("perm") if by else F.lit(0))

    deep = got.sums.filter("max_delta IS NOT NULL").withColumn("at", F.col("perm")).groupBy("aln_id").agg(vector("max_delta").alias("values")).withColumn("seq", F.lit(0))
    # Ranks are written as soon as they are asked for.
    each = (lambda: log, score, lambda: sequence, end, lambda: chi2_of(got.before), lambda: chi2_of(got.after), lambda: chi2_of(got.null, "perm"), lambda: deep)
    return reduce(DataFrame.unionByName, [shaped(make(), kind) for kind, make in zip(KINDS, each) if kind in kinds])
