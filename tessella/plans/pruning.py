"""Pruning as a loop over tables, for all alignments at once and for alignments of any size.

State is in tables of the shared folder; the driver sees one row of flags a turn. Per alignment:

- tiles never change; what is taken out is a table of sites, which the columns bound;
- margins (each taxon's raw counts) have a version a turn. A new version is the one before less the counts of the sites of a
  batch, read from their tiles alone; the cells of the others are not counted again;
- the log is appended to. A batch has the number of the turn that took it out and of the sites taken out before it; going back
  is a row that names that turn, and the margins of the version before it become the next version. Its tables are put together
  every FOLD turns, and what only a turn reads is deleted after it, as there is no limit to the turns but the columns;
- a null has a generation; a renewal adds one, over the sites that are left.

A turn scores the margins, tells whether the alignment still counts as biased, scores the removal of each site, takes the
longest prefix of the best sites that the delta null justifies, and decides (`decided`): take the batch out, go back, renew
the null, or stop. Deciding is a projection of the alignments' control rows, so alignments of many sizes and states of
progress go on together.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import composition as comp
from ..operators import delta as site_delta
from ..operators import null as nulls
from ..operators import tiles as tile
from ..sources.shared import discard, noted, written

#: The algorithms and what is reported as the reason to stop.
ALGORITHMS = ("squared", "quartic", "wasserstein")
NOT_BIASED = "alignment p-value"
NOT_SIGNIFICANT = "delta not significant (p=%.3f, max_delta=%.6f)"
CAPPED = "reached --max_residue_pruned cap ({})"
EMPTY = "no columns left"
#: Quantiles of the null at most.
MOST_QUANTILES = 200
#: Tables of the log that are put together.
FOLD = 16


class Settings(NamedTuple):
    """most: sites to take out, or None to go on until the alignment or its best site is no longer significant."""

    algorithm: str = "wasserstein"
    most: int | None = 100
    permutations: int = 100
    top_n: int = 1
    delta_null: bool = True
    recomputes: int | None = 1
    seed: int = nulls.SEED

    @property
    def level(self) -> float:
        return 0.95 if self.delta_null else nulls.SIGNIFICANT

    @property
    def fine(self) -> int:
        """The batch size after going back."""
        return max(1, self.top_n // 10)


class Pruned(NamedTuple):
    """log (aln_id, version, seq, turn, rank, col_idx, global_chi2, score, delta, biased, p), before and after (aln_id, taxon_idx, chi2),
    removed (aln_id, col_idx), ends (aln_id, reason, used, turn, gen), and of the first null and the last one their tables."""

    log: DataFrame
    before: DataFrame
    after: DataFrame
    removed: DataFrame
    ends: DataFrame
    null: DataFrame
    sums: DataFrame


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class Nulls:
    """Generations of the permutation null: sums (aln_id, gen, perm, total, max_delta), refs (aln_id, gen, tau, z_mean,
    z_scale, q). Only tables; a generation holds the alignments that were renewed to it."""

    def __init__(self, n_states: int, s: Settings, k: int):
        self.n, self.s, self.k, self.sums, self.refs, self.first = n_states, s, k, [], [], None

    def add(self, made: DataFrame, gens: DataFrame) -> None:
        """The null of the tiles of gens' alignments (aln_id, gen)."""
        s, n = self.s, self.n
        own = made.join(gens.select("aln_id"), "aln_id", "left_semi")
        scores = nulls.null_chi2(own, n, s.permutations, s.seed)
        ranks = written(nulls.pool(scores), "null-ranks")
        ref = nulls.threshold(scores.filter("perm = 0"), scores, ranks)
        if s.algorithm == "wasserstein":
            z = written(nulls.reference(scores, self.k, ranks), "null-reference")
            if (flat := z.filter("NOT z_scale > 0").first()) is not None:
                raise ValueError(f"{flat['aln_id']}: the null has no spread, so Z scores do not exist; use another algorithm")
            ref = ref.join(z, "aln_id")
        ref = written(ref.join(gens, "aln_id"), "null-refs")
        sums = scores.groupBy("aln_id", "perm").agg(F.sum("chi2").alias("total"))
        if s.delta_null:
            most = site_delta.delta_null(own, n, s.permutations, s.seed + s.permutations, s.algorithm, ref if s.algorithm == "wasserstein" else None, self.k)
            sums = sums.join(most, ["aln_id", "perm"], "left")
        else:
            sums = sums.withColumn("max_delta", F.lit(None).cast("double"))
        self.refs.append(ref)
        self.sums.append(written(sums.join(gens, "aln_id"), "null-sums"))
        self.first = self.first if self.first is not None else scores

    def of(self, tables: list[DataFrame], control: DataFrame) -> DataFrame:
        return union(tables).join(control.select("aln_id", "gen"), ["aln_id", "gen"], "left_semi").drop("gen")


def _judged(deltas: DataFrame, control: DataFrame, sums: DataFrame, s: Settings) -> DataFrame:
    """(aln_id, rank, col_idx, delta, score, p, fine) of each alignment's next candidates; fine: it and all before it are
    justified. Without a delta null all are, and p is null."""
    order = Window.partitionBy("aln_id").orderBy(F.round("delta", 9).desc(), "col_idx")
    top = site_delta.top_sites(deltas, s.top_n).withColumn("rank", F.row_number().over(order)).join(control.select("aln_id", "top_n"), "aln_id").filter("rank <= top_n")
    top = top.select("aln_id", "rank", "col_idx", "delta", F.col("base").alias("score"))
    if not s.delta_null:
        return top.withColumn("p", F.lit(None).cast("double")).withColumn("fine", F.lit(True))
    # A parameter bounds both sides: top_n candidates and the permutations of an alignment.
    reach = top.join(sums.select("aln_id", "max_delta"), "aln_id").groupBy(*top.columns).agg(F.avg(F.when(F.col("max_delta") >= F.col("delta"), 1.0).otherwise(0.0)).alias("p"))
    worst = F.max("p").over(Window.partitionBy("aln_id").orderBy("rank"))
    return reach.withColumn("fine", worst <= nulls.SIGNIFICANT)


def decided(state: DataFrame, turn_no: int, s: Settings) -> DataFrame:
    """Control rows after a turn. state has the control row and total, biased, p, seen (candidates), good (justified ones),
    p1 and delta1 (the first candidate's)."""
    lit = F.lit
    over = F.col("p") > s.level
    short = ~over & (F.col("good") < F.col("seen"))
    none = ~over & (F.col("good") == 0)
    back = (over | (short & ~none)) & ~F.col("calm") & (F.col("top_n") > s.fine) & (F.col("batch") > 0)
    size = F.col("live") + F.when(back, F.col("batch")).otherwise(0)
    budget = lit(True) if s.recomputes is None else F.col("used") < s.recomputes
    renew = (over | short) & (F.col("turn") > 0) & (F.col("sized").isNull() | (size != F.col("sized"))) & budget
    stop = ~back & ~renew & (over | none)
    take = ~back & ~renew & ~stop
    flagged = state.select("*", back.alias("back"), renew.alias("renew"), stop.alias("stop"), take.alias("take"), size.cast("long").alias("size"), over.alias("over"))
    done = F.col("done") + F.when(F.col("back"), 0).otherwise(F.col("batch"))
    batch = F.when(F.col("take"), F.col("good")).otherwise(0).cast("long")
    live = F.col("size") - batch
    full = lit(False) if s.most is None else F.col("take") & (done + batch >= s.most)
    reason = (
        F.when(F.col("stop") & F.col("over"), NOT_BIASED)
        .when(F.col("stop"), F.format_string(NOT_SIGNIFICANT, "p1", "delta1"))
        .when(F.col("take") & (live <= 0), EMPTY)
        .when(full, CAPPED.format(s.most))
    )
    return flagged.select(
        "aln_id", "total", "biased", "back", "renew", "take",
        F.col("last").alias("was"), F.col("prev").alias("before"), (F.col("batch") > 0).alias("logged"),
        reason.alias("reason"), (F.col("turn") + F.col("take").cast("int")).alias("turn"), done.cast("long").alias("done"), batch.alias("batch"),
        F.when(F.col("take"), lit(turn_no)).otherwise(F.col("last")).alias("last"), F.when(F.col("take"), lit(turn_no)).otherwise(F.col("prev")).alias("prev"),
        F.when(F.col("back"), lit(s.fine)).otherwise(F.col("top_n")).alias("top_n"), (F.col("calm") | F.col("back")).alias("calm"),
        (F.col("used") + F.col("renew").cast("int")).alias("used"), F.when(F.col("renew"), F.col("size")).otherwise(F.col("sized")).alias("sized"),
        live.alias("live"), (F.col("gen") + F.col("renew").cast("int")).alias("gen"),
    )


LOG = "aln_id string, version int, seq long, turn int, rank int, col_idx int, global_chi2 double, score double, delta double, biased long, p double"
CONTROL = ("aln_id", "reason", "turn", "done", "batch", "last", "prev", "top_n", "calm", "used", "sized", "live", "gen")


def _begun(made: DataFrame, s: Settings) -> DataFrame:
    size = made.filter("taxon_block = 0").groupBy("aln_id").agg(F.sum(F.length("sites") / 4).cast("long").alias("live"))
    none = F.lit(None).cast("int")
    done = F.when(F.lit(s.most is not None and s.most <= 0), CAPPED.format(s.most)).cast("string")
    start = {"reason": done, "turn": F.lit(0), "done": F.lit(0).cast("long"), "batch": F.lit(0).cast("long"), "last": none, "prev": none, "top_n": F.lit(s.top_n), "calm": F.lit(False), "used": F.lit(0), "sized": F.lit(None).cast("long"), "live": F.col("live"), "gen": F.lit(0)}
    return size.select("aln_id", *[v.alias(k) for k, v in start.items()])


def less(margins: DataFrame, gone: DataFrame) -> DataFrame:
    """margins less the counts gone (aln_id, taxon_idx, o)."""
    both = margins.join(gone.withColumnRenamed("o", "less"), ["aln_id", "taxon_idx"], "left")
    return both.select("aln_id", "taxon_idx", F.when(F.col("less").isNull(), F.col("o")).otherwise(F.zip_with("o", "less", lambda a, b: a - b)).alias("o"))


def prune_tiles(made: DataFrame, n_states: int, s: Settings = Settings(), k: int = MOST_QUANTILES) -> Pruned:
    """Prune every alignment of tiles (see the module). k: quantiles of the null, for the wasserstein algorithm."""
    if s.algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {s.algorithm!r}; one of {', '.join(ALGORITHMS)}")
    spark = made.sparkSession
    control = written(_begun(made, s), "control")
    null = Nulls(n_states, s, k)
    null.add(made, control.select("aln_id", "gen"))
    versions = {0: written(tile.margins(made, n_states), "margins")}
    before = written(comp.chi2_of(versions[0], n_states), "before")
    removed = spark.createDataFrame([], "aln_id string, col_idx int, version int")
    batches, undone_, stats, at = [], [], [], 0
    small, going = tile.fits(made, n_states), (s.most is None or s.most > 0) and control.take(1)
    while going:
        live = control.filter("reason IS NULL").select(*CONTROL)
        refs, sums = null.of(null.refs, live), null.of(null.sums, live)
        with noted() as passing:
            f = written(comp.fudged(versions[at].join(live.select("aln_id"), "aln_id", "left_semi"), n_states), "fudged")
            scored = comp.scores(f).join(refs.select("aln_id", "tau"), "aln_id")
            now = scored.groupBy("aln_id").agg(F.sum("chi2").alias("total"), F.count_if(F.col("chi2") > F.col("tau")).alias("biased"))
            state = written(live.join(_p_of(now, sums), "aln_id"), "state")
            biased = state.filter(F.col("p") <= s.level)
            left = tile.without(made.join(biased.select("aln_id"), "aln_id", "left_semi"), removed)
            found = site_delta.site_deltas(left, n_states, s.algorithm, refs if s.algorithm == "wasserstein" else None, k, f.join(biased.select("aln_id"), "aln_id", "left_semi"), small)
            judged = written(_judged(found, biased, sums, s), "candidates")
        first = F.col("rank") == 1
        some = judged.groupBy("aln_id").agg(F.count("*").alias("seen"), F.count_if("fine").alias("good"), F.max(F.when(first, F.col("p"))).alias("p1"), F.max(F.when(first, F.col("delta"))).alias("delta1"))
        after = decided(state.join(some, "aln_id", "left").fillna({"seen": 0, "good": 0}), at, s)
        stopped = control.filter("reason IS NOT NULL")
        control = written(after.unionByName(stopped.select(*CONTROL), allowMissingColumns=True), "control")
        stats.append(control.filter("logged").select("aln_id", F.col("was").alias("version"), "total", "biased"))
        batch = written(judged.filter("fine").join(control.filter("take").select("aln_id", "turn", "done"), "aln_id").withColumn("version", F.lit(at)), "log-batch")
        batches.append(batch)
        # One row of flags for all alignments. An earlier version is read when its alignment goes back over its last batch.
        may = F.col("reason").isNull() & ~F.col("calm")
        going_on = F.count_if(F.col("reason").isNull()).alias("going")
        flags = control.agg(F.max("back").alias("back"), F.max("renew").alias("renew"), F.max("take").alias("take"), going_on, F.collect_set(F.when(F.col("back"), F.col("before"))).alias("before"), F.collect_set(F.when(may, F.col("prev"))).alias("needed")).first()
        following, going = versions[at], flags["going"]
        if flags["take"]:
            following = less(following, tile.margins(tile.only(made, batch), n_states))
            removed = removed.union(batch.select("aln_id", "col_idx", "version"))
        if flags["back"]:
            undone = control.filter("back").select("aln_id", F.col("was").alias("version"), "before")
            stay = following.join(undone.select("aln_id"), "aln_id", "left_anti")
            earlier = [versions[v].join(undone.filter(F.col("before") == v).select("aln_id"), "aln_id", "left_semi") for v in flags["before"]]
            following = union([stay, *earlier])
            removed = removed.join(undone.select("aln_id", "version"), ["aln_id", "version"], "left_anti").select("aln_id", "col_idx", "version")
            undone_.append(undone.select("aln_id", "version"))
        removed = written(removed, "removed")
        if flags["renew"]:
            null.add(tile.without(made, removed), control.filter("renew").select("aln_id", "gen"))
        at += 1
        versions[at] = written(following, "margins")
        batches, undone_, stats = _put_together(batches), _put_together(undone_), _put_together(stats)
        discard(*passing, *[versions.pop(v) for v in [*versions] if v not in {at, *flags["needed"]}])
    after = written(comp.chi2_of(versions[at], n_states), "after")
    # The last batch of an alignment that ran into the cap has not been scored yet.
    pending = control.filter("batch > 0").select("aln_id", F.col("last").alias("version"), "gen")
    end = after.join(null.of(null.refs, control).select("aln_id", "tau"), "aln_id").groupBy("aln_id").agg(F.sum("chi2").alias("total"), F.count_if(F.col("chi2") > F.col("tau")).alias("biased"))
    stats.append(pending.join(end, "aln_id").select("aln_id", "version", "total", "biased"))
    ends = control.select("aln_id", "reason", "used", "turn", "gen")
    log = _log(batches, undone_, stats) if batches else spark.createDataFrame([], LOG)
    return Pruned(log, before, after, removed.select("aln_id", "col_idx"), ends, null.first, null.of(null.sums, control))


def _p_of(now: DataFrame, sums: DataFrame) -> DataFrame:
    """now with p: the share of permutations whose total is at least the alignment's."""
    reach = sums.select("aln_id", F.col("total").alias("drawn")).join(now, "aln_id")
    return reach.groupBy("aln_id", "total", "biased").agg(F.avg(F.when(F.col("drawn") >= F.col("total"), 1.0).otherwise(0.0)).alias("p"))


def _put_together(tables: list[DataFrame]) -> list[DataFrame]:
    """One table instead of FOLD, so that plans do not grow with the turns."""
    return tables if len(tables) < FOLD else [written(union(tables), "log")]


def _log(batches: list[DataFrame], undone: list[DataFrame], stats: list[DataFrame]) -> DataFrame:
    """The batches that stand, each site with its place and the scores after its batch."""
    taken = union(batches)
    if undone:
        taken = taken.join(union(undone), ["aln_id", "version"], "left_anti")
    scores, seq = union(stats), (F.col("done") + F.col("rank") - 1).cast("long").alias("seq")
    return taken.join(scores, ["aln_id", "version"]).select("aln_id", "version", seq, "turn", "rank", "col_idx", F.col("total").alias("global_chi2"), "score", "delta", "biased", "p")
