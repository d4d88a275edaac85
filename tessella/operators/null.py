"""The permutation null: every column shuffled over the taxa on its own, and what the scorers make of it.

A permutation sends each cell of a site to another taxon by a key of (seed + permutation, site), so it is the same on any
number of partitions and in any SQL engine, and neither sorts nor moves cells: tiles add up the counts of every permuted
matrix where they are, and one row of counts for each taxon and permutation is what Spark merges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import composition as comp
from . import tiles as tile
from .ranks import at_positions, ranked

SEED, SIGNIFICANT = 12345, 0.05
MAD_SCALE = 0.6745


def permuted(made: DataFrame, permutations: int, seed: int = SEED) -> DataFrame:
    """(aln_id, perm, taxon_idx, col_idx, code) of every permutation of tiles; to look at, as counts need no such cells."""
    return tile.permuted_cells(made, permutations, seed)


def null_chi2(made: DataFrame, n_states: int, permutations: int, seed: int = SEED) -> DataFrame:
    """(aln_id, perm, taxon_idx, chi2) of tiles, written once for the many statistics that read it."""
    counts = tile.permuted_counts(made, n_states, permutations, seed)
    return written(comp.chi2_of(counts, n_states, ("aln_id", "perm")), "null")


def summary(null: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aln_id, perm, total, mx) and (aln_id, q75, q95)."""
    per = null.groupBy("aln_id", "perm").agg(F.sum("chi2").alias("total"), F.max("chi2").alias("mx"))
    pooled = at_positions(pool(null), ("aln_id",), "chi2", [0.75, 0.95])
    return per, pooled.select("aln_id", F.col("q")[0].alias("q75"), F.col("q")[1].alias("q95"))


def pool(null: DataFrame) -> DataFrame:
    """(aln_id, chi2, n, at): the scores of all permutations and taxa, ranked."""
    return ranked(null.select("aln_id", "chi2", "perm", "taxon_idx"), ("aln_id",), "chi2", ("perm", "taxon_idx"))


def reference(null: DataFrame, k: int, ranks: DataFrame | None = None) -> DataFrame:
    """(aln_id, z_mean, z_scale, q): mean, scaled MAD and k quantiles of the null's Z scores; ranks are its pool's."""
    ranks = pool(null) if ranks is None else ranks
    s = comp.spread_of(ranks).select("aln_id", F.col("mean").alias("z_mean"), (F.col("mad") / F.lit(MAD_SCALE)).alias("z_scale"))
    q = at_positions(ranks, ("aln_id",), "chi2", comp.positions(k))
    return s.join(q, "aln_id").withColumn("q", F.transform("q", lambda x: (x - F.col("z_mean")) / F.nullif("z_scale", F.lit(0.0))))


def empirical_p_alignment(chi2: DataFrame, null: DataFrame) -> DataFrame:
    """(aln_id, global_chi2, p): the share of permutations whose total is at least the observed."""
    seen = comp.summary(chi2).select("aln_id", "global_chi2")
    per = null.groupBy("aln_id", "perm").agg(F.sum("chi2").alias("total"))
    hit = F.when(F.col("total") >= F.col("global_chi2"), 1.0).otherwise(0.0)
    return per.join(seen, "aln_id").groupBy("aln_id").agg(F.first("global_chi2").alias("global_chi2"), F.avg(hit).alias("p"))


def empirical_p_taxon(chi2: DataFrame, null: DataFrame) -> DataFrame:
    """(aln_id, taxon_idx, chi2, p): Bonferroni-corrected share of pooled null scores at least the taxon's.

    Both sides are ranked together, a taxon's score before equal ones of the null, so what comes before it is less than it.
    """
    drawn = null.select("aln_id", "chi2", F.lit(1).alias("drawn"), "perm", "taxon_idx")
    seen = chi2.select("aln_id", "chi2", F.lit(0).alias("drawn"), F.lit(-1).alias("perm"), "taxon_idx")
    ranks = ranked(drawn.union(seen), ("aln_id",), "chi2", ("drawn", "perm", "taxon_idx"), F.col("drawn") == 1)
    taxa = chi2.groupBy("aln_id").agg(F.count("*").alias("t"))
    p = F.least(F.lit(1.0), (F.col("n") - F.col("at")).cast("double") / F.col("n") * F.col("t"))
    return ranks.filter("drawn = 0").join(taxa, "aln_id").select("aln_id", "taxon_idx", "chi2", p.alias("p"))


def robust_z(chi2: DataFrame, null: DataFrame) -> DataFrame:
    """(aln_id, taxon_idx, z): off the null's mean in units of its scaled MAD; 0 or an infinity where that is 0."""
    s = comp.spread(null).select("aln_id", "mean", (F.col("mad") / F.lit(MAD_SCALE)).alias("scale"))
    d = F.col("chi2") - F.col("mean")
    z = F.when(F.col("scale") > 0, d / F.nullif("scale", F.lit(0.0))).when(d == 0, 0.0).when(d > 0, float("inf")).otherwise(float("-inf"))
    return chi2.join(s, "aln_id").select("aln_id", "taxon_idx", z.alias("z"))


def threshold(chi2: DataFrame, null: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(aln_id, tau): the order statistic that a biased taxon's score exceeds; infinite if there is none."""
    taxa = chi2.groupBy("aln_id").agg(F.count("*").alias("t"))
    deep = F.col("n") - F.floor(F.lit(SIGNIFICANT) * F.col("n") / F.col("t")) - 1
    at = (pool(null) if ranks is None else ranks).join(taxa, "aln_id").filter(F.col("at") == deep)
    return taxa.join(at.select("aln_id", "chi2"), "aln_id", "left").select("aln_id", F.coalesce("chi2", F.lit(float("inf"))).alias("tau"))


def taxon_scores(chi2: DataFrame, null: DataFrame) -> DataFrame:
    """(aln_id, taxon_idx, chi2, p, z, biased)."""
    got = empirical_p_taxon(chi2, null).join(robust_z(chi2, null), ["aln_id", "taxon_idx"])
    return got.withColumn("biased", F.col("p") < SIGNIFICANT)
