"""How much each site's removal would lower a bias score.

Tiles (operators.tiles) meet the counts of their matrix's taxa and sum up each site's part of the score; only sites' sums
are shuffled. Where the counts of all taxa are too many for one row, `without_site` does the same in long form: a cell meets
its site's adjusted totals and its taxon's counts in two equi-joins, and gets the taxon's score without the site.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import composition as comp
from . import tiles as tile

KEYS = ("aln_id",)
RANKED = ("wasserstein", "wasserstein_raw")


class Fold(NamedTuple):
    """How the scores of taxa become one: each score through `each`, which works on a Column and on a numpy array alike, and
    the results put together by `merge`: sum, max or min."""

    each: Callable
    merge: str


FOLDS = {"squared": Fold(lambda x: x, "sum"), "quartic": Fold(lambda x: x * x, "sum")}
SCORERS = (*FOLDS, *RANKED)


def register_fold(name: str, each: Callable, merge: str = "sum") -> None:
    """Make a fold of one's own a scorer of site_deltas, null_deltas and delta_null.

    It must be the same however taxa are split into tiles; that is tried on random scores, and a fold that depends on the
    other scores beside it (a rank, a mean) raises.
    """
    if merge not in ("sum", "max", "min"):
        raise ValueError(f"unknown merge {merge!r}; one of sum, max, min")
    if name in FOLDS or name in RANKED:
        raise ValueError(f"{name!r} is a scorer already")
    x = np.random.default_rng(0).gamma(2.0, 3.0, (64, 5))
    put = getattr(np, merge)
    whole = put(each(x), axis=0)
    for cut in (1, 7, 40):
        parts = put(np.stack([put(each(x[:cut]), axis=0), put(each(x[cut:]), axis=0)]), axis=0)
        if np.shape(whole) != (5,) or not np.allclose(whole, parts):
            raise ValueError(f"the fold {name!r} is not the same when taxa are split")
    FOLDS[name] = Fold(each, merge)


def without_site(cells: DataFrame, f: DataFrame, n_states: int, keys=KEYS) -> DataFrame:
    """(keys, col_idx, taxon_idx, chi2): every taxon's score without each site; f are fudged counts.

    A site that leaves a state or a taxon without any count takes the direct formula, where all expected counts get one
    more if some is zero.
    """
    site = cells.groupBy(*keys, "col_idx").agg(F.array(*[F.count_if(F.col("code") == c) for c in range(n_states)]).alias("gone"))
    both = cells.join(site, [*keys, "col_idx"]).join(f, [*keys, "taxon_idx"])
    g = F.when(F.col("code") >= 0, 1).otherwise(0)
    left = both.withColumn("tcj", F.zip_with("tc", "gone", lambda a, b: a - b)).withColumn("ctj", F.col("ct") - g)
    own = F.transform("o", lambda x, c: x - F.when(c == F.col("code"), 1).otherwise(0))
    left = left.withColumn("nj", F.aggregate("tcj", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")).withColumn("oj", own)
    low = left.groupBy(*keys, "col_idx").agg(F.max(F.exists("tcj", lambda x: x <= 0) | (F.col("ctj") <= 0)).alias("bare"))
    # The usual case, sum of O^2 / E less the taxon's total, with E = tcj / nj * ctj.
    inner = F.zip_with("oj", "tcj", lambda o, s: F.coalesce(F.try_divide((o * o).cast("double") * F.col("nj"), s.cast("double")), F.lit(0.0)))
    usual = F.try_divide(F.aggregate(inner, F.lit(0.0), lambda a, x: a + x), F.col("ctj").cast("double")) - F.col("ctj")
    plain = lambda s: F.coalesce(F.try_divide(s.cast("double"), F.col("nj")), F.lit(0.0)) * F.col("ctj") + 1.0
    direct = F.aggregate(F.zip_with("oj", "tcj", lambda o, s: (o - plain(s)) * (o - plain(s)) / plain(s)), F.lit(0.0), lambda a, x: a + x)
    joined = left.join(low, [*keys, "col_idx"])
    return joined.select(*keys, "col_idx", "taxon_idx", F.when(F.col("bare"), direct).otherwise(usual).alias("chi2"))


def checked(scorer: str) -> str:
    if scorer not in FOLDS and scorer not in RANKED:
        raise ValueError(f"unknown scorer {scorer!r}; one of {', '.join([*FOLDS, *RANKED])}")
    return scorer


def merged(scorer: str) -> Callable:
    return {"sum": F.sum, "max": F.max, "min": F.min}[FOLDS[scorer].merge]


def _base(now: DataFrame, scorer: str, ref: DataFrame | None, k: int, keys) -> DataFrame:
    """(keys, base): the score before any removal, of chi-squared by taxon."""
    if scorer in FOLDS:
        return now.groupBy(*keys).agg(merged(scorer)(FOLDS[scorer].each(F.col("chi2"))).alias("base"))
    return comp.wasserstein(_on_z(now, ref) if scorer == "wasserstein" else now, ref.select("aln_id", "q"), k, keys=keys).withColumnRenamed("w", "base")


def _on_z(chi2: DataFrame, ref: DataFrame) -> DataFrame:
    return chi2.join(ref.drop("q"), "aln_id").withColumn("chi2", (F.col("chi2") - F.col("z_mean")) / F.nullif("z_scale", F.lit(0.0)))


def site_deltas(made: DataFrame, n_states: int, scorer: str = "squared", ref: DataFrame | None = None, k: int = 0, fudged: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """(aln_id, col_idx, delta, base) of tiles; ref is the null's (aln_id, z_mean, z_scale, q) for the wasserstein scorers.

    fudged are the fudged counts over the tiles' sites and small what tiles.fits says, where they are known.
    """
    checked(scorer)
    f = written(comp.fudged(written(tile.margins(made, n_states), "counts"), n_states), "fudged") if fudged is None else fudged
    return _deltas(made, f, n_states, scorer, ref, k, small=small)


def null_deltas(made: DataFrame, n_states: int, permutations: int, seed: int, scorer: str = "squared", ref: DataFrame | None = None, k: int = 0) -> DataFrame:
    """(aln_id, perm, col_idx, delta, base) of every permutation of tiles."""
    checked(scorer)
    raw = written(tile.permuted_counts(made, n_states, permutations, seed), "counts")
    return _deltas(made, written(comp.fudged(raw, n_states, ("aln_id", "perm")), "fudged"), n_states, scorer, ref, k, seed, permutations)


def _deltas(made: DataFrame, f: DataFrame, n_states: int, scorer: str, ref: DataFrame | None, k: int, seed: int | None = None, permutations: int = 0, small: bool | None = None) -> DataFrame:
    keys = ["aln_id"] if seed is None else ["aln_id", "perm"]
    base = _base(comp.scores(f, keys), scorer, ref, k, keys)
    if tile.fits(made, n_states) if small is None else small:
        w = tile.folded(made, f, n_states, FOLDS.get(scorer, scorer), seed, permutations, ref, k)
    else:
        cells = tile.plain_cells(made) if seed is None else tile.permuted_cells(made, permutations, seed)
        w = _by_cells(cells, f, n_states, scorer, ref, k, keys)
    return written(w.join(base, keys).select(*keys, "col_idx", (F.col("base") - F.col("w")).alias("delta"), "base"), "deltas")


def _by_cells(cells: DataFrame, f: DataFrame, n_states: int, scorer: str, ref: DataFrame | None, k: int, keys) -> DataFrame:
    """(keys, col_idx, w) for matrices whose taxa's counts are too many for one row."""
    then, by = without_site(cells, f, n_states, keys), [*keys, "col_idx"]
    if scorer in FOLDS:
        return then.groupBy(*by).agg(merged(scorer)(FOLDS[scorer].each(F.col("chi2"))).alias("w"))
    return comp.wasserstein(_on_z(then, ref) if scorer == "wasserstein" else then, ref.select("aln_id", "q"), k, keys=by)


def top_sites(deltas: DataFrame, n: int) -> DataFrame:
    """The n sites of the highest delta of each alignment; ties to the lower column."""
    from pyspark.sql import Window

    # Spark keeps n rows of an alignment in each task before the shuffle.
    order = Window.partitionBy("aln_id").orderBy(F.round("delta", 9).desc(), "col_idx")
    return deltas.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")


def delta_null(made: DataFrame, n_states: int, permutations: int, seed: int, scorer: str = "squared", ref: DataFrame | None = None, k: int = 0) -> DataFrame:
    """(aln_id, perm, max_delta) of tiles; the seed goes on from the main null's last one."""
    each = null_deltas(made, n_states, permutations, seed, scorer, ref, k)
    return each.groupBy("aln_id", "perm").agg(F.max("delta").alias("max_delta"))


def justified(top: DataFrame, null_max: DataFrame, level: float = 0.05) -> DataFrame:
    """(aln_id, rank, col_idx, delta, p): the longest prefix of top sites whose delta the null reaches rarely enough."""
    from pyspark.sql import Window

    order = Window.partitionBy("aln_id").orderBy(F.round("delta", 9).desc(), "col_idx")
    ranked = top.withColumn("rank", F.row_number().over(order))
    p = ranked.join(null_max, "aln_id").groupBy("aln_id", "rank", "col_idx", "delta").agg(F.avg(F.when(F.col("max_delta") >= F.col("delta"), 1.0).otherwise(0.0)).alias("p"))
    worst = F.max("p").over(Window.partitionBy("aln_id").orderBy("rank"))
    return p.withColumn("worst", worst).filter(F.col("worst") <= level).drop("worst")
