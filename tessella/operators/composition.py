"""Composition of each row of a matrix and its chi-squared scores.

One aggregation turns cells into one row per taxon with an array of state counts. Totals over taxa are one row per
matrix and join back. `keys` names what tells matrices apart (an alignment, or an alignment and a permutation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranks import at_positions, ranked

KEYS = ("aln_id",)


def counts(cells: DataFrame, n_states: int, keys=KEYS) -> DataFrame:
    """(keys, taxon_idx, o): how often each state occurs; taxa whose cells are all gaps have zeros."""
    each = [F.count_if(F.col("code") == c) for c in range(n_states)]
    return cells.groupBy(*keys, "taxon_idx").agg(F.array(*each).alias("o"))


def totals(o: DataFrame, n_states: int, keys=KEYS) -> DataFrame:
    """(keys, n_taxa, tc, zero): per matrix, each state's total and whether some count is zero."""
    return o.groupBy(*keys).agg(F.count("*").alias("n_taxa"), F.array(*[F.sum(F.col("o")[c]) for c in range(n_states)]).alias("tc"), F.max(F.array_contains(F.col("o"), F.lit(0).cast("long"))).alias("zero"))


def fudged(o: DataFrame, n_states: int, keys=KEYS) -> DataFrame:
    """(keys, taxon_idx, o, ct, tc, n): counts, plus one everywhere if the matrix has a zero count; with margins.

    The totals are written, so that Spark knows how few they are beside the counts: it would broadcast those otherwise.
    """
    plus = F.col("zero").cast("long")
    got = o.join(written(totals(o, n_states, keys), "totals"), list(keys))
    got = got.withColumn("o", F.transform("o", lambda x: x + plus)).withColumn("tc", F.transform("tc", lambda x: x + plus * F.col("n_taxa")))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select(*keys, "taxon_idx", "o", add(F.col("o")).alias("ct"), "tc", add(F.col("tc")).alias("n"))


def expected():
    """Expected counts under the pooled composition; plus one everywhere if some expected count is zero."""
    plain = F.transform("tc", lambda s: F.try_divide(s.cast("double"), F.col("n").cast("double")) * F.col("ct"))
    zero = F.exists("tc", lambda s: s == 0) | (F.col("ct") == 0)
    return F.transform(plain, lambda e: F.coalesce(e, F.lit(0.0)) + F.when(zero, 1.0).otherwise(0.0))


def scores(f: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, taxon_idx, chi2) of fudged counts."""
    parts = F.zip_with("o", "e", lambda o, e: (o - e) * (o - e) / e)
    return f.withColumn("e", expected()).select(*keys, "taxon_idx", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("chi2"))


def row_chi2(cells: DataFrame, n_states: int, keys=KEYS) -> DataFrame:
    return chi2_of(counts(cells, n_states, keys), n_states, keys)


def chi2_of(o: DataFrame, n_states: int, keys=KEYS) -> DataFrame:
    """(keys, taxon_idx, chi2) of raw counts, which totals and scores both read, so they are written once."""
    return scores(fudged(written(o, "counts"), n_states, keys), keys)


def summary(chi2: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, global_chi2, quartic_chi2, max_chi2) per matrix."""
    return chi2.groupBy(*keys).agg(F.sum("chi2").alias("global_chi2"), F.sum(F.col("chi2") * F.col("chi2")).alias("quartic_chi2"), F.max("chi2").alias("max_chi2"))


def spread(values: DataFrame, column: str = "chi2", keys=KEYS) -> DataFrame:
    """(keys, mean, median, mad): type-7 median and median absolute deviation."""
    return spread_of(ranked(values.select(*keys, column), keys, column), column, keys)


def spread_of(ranks: DataFrame, column: str = "chi2", keys=KEYS) -> DataFrame:
    """spread of values that are ranked."""
    mid = written(ranks.groupBy(*keys).agg(F.avg(column).alias("mean")).join(at_positions(ranks, keys, column, [0.5]), list(keys)).select(*keys, "mean", F.col("q")[0].alias("median")), "medians")
    off = ranks.select(*keys, column).join(mid, list(keys)).select(*keys, F.abs(F.col(column) - F.col("median")).alias("off"))
    mad = at_positions(ranked(off, keys, "off"), keys, "off", [0.5])
    return mid.join(mad, list(keys)).select(*keys, "mean", "median", F.col("q")[0].alias("mad"))


def positions(k: int) -> list[float]:
    return [i / (k + 1) for i in range(1, k + 1)]


def quantiles(values: DataFrame, k: int, column: str = "chi2", keys=KEYS) -> DataFrame:
    """(keys, q): k inner type-7 quantiles at i / (k + 1)."""
    return at_positions(ranked(values.select(*keys, column), keys, column), keys, column, positions(k))


def wasserstein(observed: DataFrame, null_q: DataFrame, k: int, column: str = "chi2", keys=KEYS, null_keys=KEYS) -> DataFrame:
    """(keys, w): mean absolute difference of k quantiles from the null's (null_keys, q)."""
    q = quantiles(observed, k, column, keys).withColumnRenamed("q", "oq")
    off = F.zip_with("oq", "q", lambda a, b: F.abs(a - b))
    return q.join(null_q, list(null_keys)).select(*keys, (F.aggregate(off, F.lit(0.0), lambda a, x: a + x) / F.lit(float(k))).alias("w"))


def histogram(values: DataFrame, bins: int, column: str = "chi2", keys=KEYS) -> DataFrame:
    """(keys, bin, low, n): equal bins from the least to the greatest value, empty ones left out; n values from low on."""
    ends = values.groupBy(*keys).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * F.lit(bins))
    placed = values.join(ends, list(keys)).withColumn("bin", F.least(F.lit(bins - 1).cast("long"), F.coalesce(at, F.lit(0).cast("long"))))
    low = F.first(F.col("lo") + (F.col("hi") - F.col("lo")) / F.lit(float(bins)) * F.col("bin"))
    return placed.groupBy(*keys, "bin").agg(low.alias("low"), F.count("*").alias("n"))


def density(values: DataFrame, points: int, column: str = "chi2", keys=KEYS) -> DataFrame:
    """(keys, point, x, density): a Gaussian kernel density of the logarithms of the positive values, on an even grid.

    The bandwidth is the logarithms' deviation over the fifth root of their number; the grid begins and ends three bandwidths
    beyond them. Each value is shared between its two grid points, so what is summed over the kernel is `points` weights of
    a group, however many values it has. Groups of fewer than two different values have no density. The values are written,
    as the filter and both passes over them would each work them out anew.
    """
    keys = list(keys)
    logs = written(values.select(*keys, column), "values").filter(F.col(column) > 0).select(*keys, F.ln(column).alias("_x"))
    size = logs.groupBy(*keys).agg(F.count("*").alias("_n"), F.stddev("_x").alias("_sd"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).filter("_hi > _lo")
    size = size.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    size = size.withColumn("_from", F.col("_lo") - F.lit(3.0) * F.col("_h")).withColumn("_step", (F.col("_hi") - F.col("_lo") + F.lit(6.0) * F.col("_h")) / F.lit(float(points - 1)))
    at = logs.join(size, keys).withColumn("_at", (F.col("_x") - F.col("_from")) / F.col("_step"))
    low = F.least(F.floor("_at").cast("int"), F.lit(points - 2))
    shares = F.array(F.struct(low.alias("i"), (1.0 - (F.col("_at") - low)).alias("w")), F.struct((low + 1).alias("i"), (F.col("_at") - low).alias("w")))
    weights = at.select(*keys, F.explode(shares).alias("s")).groupBy(*keys, "s.i").agg(F.sum("s.w").alias("w"))
    held = weights.groupBy(*keys).agg(F.collect_list(F.struct("i", "w")).alias("_w"))  # `points` pairs at most
    grid = size.join(held, keys).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    u = lambda s: (F.col("point") - s["i"]).cast("double") * F.col("_step") / F.col("_h")
    total = F.aggregate("_w", F.lit(0.0), lambda a, s: a + s["w"] * F.exp(F.lit(-0.5) * u(s) * u(s)))
    return grid.select(*keys, "point", F.exp(F.col("_from") + F.col("_step") * F.col("point")).alias("x"), (total / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))
