"""Keyed permutations, tiles and the prune loop against recounts in memory."""

import duckdb
import numpy as np
import pytest

from tessella.functions import keyed
from tessella.operators import composition as comp
from tessella.operators import delta, null, ranks
from tessella.operators import tiles as tile
from tessella.plans import pruning
from tessella.sources import tables
from tessella.sources.shared import written

from . import brute


@pytest.mark.parametrize("n", [1, 2, 3, 5, 15, 97, 1000, 1025])
def test_keys_permute(n):
    for seed in (0, 5, 12345, 2**31 + 7):
        key = keyed.keys(seed, np.array([0, 3, 100000]))
        to = keyed.sent(np.broadcast_to(np.arange(n)[:, None], (n, 3)), n, np.broadcast_to(key, (n, 3)))
        assert (np.sort(to, axis=0) == np.arange(n)[:, None]).all()
    assert n < 15 or (to[:, 0] != to[:, 1]).any()


def test_keys_spread_evenly():
    """Where one taxon goes, and where a second goes given the first, is even within the bounds of chance."""
    n, sites = 7, np.arange(20000)
    to = keyed.sent(np.broadcast_to(np.arange(n)[:, None], (n, len(sites))), n, np.broadcast_to(keyed.keys(12345, sites), (n, len(sites))))
    for t in range(n):
        seen = np.bincount(to[t], minlength=n)
        assert ((seen - len(sites) / n) ** 2 / (len(sites) / n)).sum() < 30
    both = np.bincount(to[0] * n + to[4], minlength=n * n).reshape(n, n)
    assert (np.diag(both) == 0).all()
    even = len(sites) / (n * (n - 1))
    assert ((both[~np.eye(n, dtype=bool)] - even) ** 2 / even).sum() < 100
    first, second = (keyed.sent(np.arange(n), n, keyed.keys(s, np.zeros(n, int))) for s in (12345, 12346))
    assert first.tolist() != second.tolist()


def test_keys_are_those_of_sql():
    rng = np.random.default_rng(1)
    s, j, n = rng.integers(0, 2**40, 300), rng.integers(0, 10**7, 300), rng.integers(1, 5000, 300)
    x = rng.integers(0, n)
    con = duckdb.connect()
    source = f"(SELECT unnest({s.tolist()}) AS s, unnest({j.tolist()}) AS j, unnest({n.tolist()}) AS n, unnest({x.tolist()}) AS x, unnest(range(300)) AS i)"
    rows = con.execute(f"SELECT y FROM {keyed.sql_nested([*keyed.sql_key('s', 'j'), *keyed.sql_step('x', 'n')], source)} ORDER BY i").fetchall()
    for (y,), a, b, m, c in zip(rows, s, j, n, x):
        grid = keyed.grid(int(m))
        if y < m:
            assert keyed.sent(np.array([c]), int(m), keyed.keys(int(a), np.array([b])))[0] == y
        assert y < grid[0] * grid[1]


def cells_of(spark, mats):
    rows = [(a, int(t), int(j), int(x[t, j])) for a, x in mats.items() for t in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "aln_id string, taxon_idx int, col_idx int, code int")


def random_matrix(seed, taxa, sites, n=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, n, (taxa, sites)).astype(np.int8)
    x[0] = np.where(rng.random(sites) < 0.5, 1, x[0])
    return x


@pytest.fixture(params=[(64, 1024), (16, 5)])
def sized(request, monkeypatch):
    """Tiles that hold all of an alignment, and tiles of a part of its sites and taxa."""
    monkeypatch.setattr(tile, "SITES", request.param[0])
    monkeypatch.setattr(tile, "TAXA", request.param[1])


def test_tiles_hold_the_cells(spark, sized):
    mats = {"a": random_matrix(1, 12, 40), "b": random_matrix(2, 3, 7)}
    made = tile.tiles(cells_of(spark, mats), 4)
    got = {(r.aln_id, r.taxon_idx): list(r.o) for r in tile.margins(made, 4).collect()}
    assert got == {(a, t): brute.matrix_counts(x, 4)[t].astype(int).tolist() for a, x in mats.items() for t in range(len(x))}
    back = {(r.aln_id, r.taxon_idx, r.col_idx): r.code for r in tile.plain_cells(made).collect()}
    assert back == {(a, t, j): x[t, j] for a, x in mats.items() for t in range(len(x)) for j in range(x.shape[1])}
    gone = spark.createDataFrame([("a", 3), ("a", 17), ("a", 18), ("b", 0)], "aln_id string, col_idx int")
    for some, keep in ((tile.only(made, gone), True), (tile.without(made, gone), False)):
        cut = {a: x[:, np.isin(np.arange(x.shape[1]), [3, 17, 18] if a == "a" else [0]) == keep] for a, x in mats.items()}
        assert {(r.aln_id, r.taxon_idx): list(r.o) for r in tile.margins(some, 4).collect()} == {(a, t): brute.matrix_counts(x, 4)[t].astype(int).tolist() for a, x in cut.items() for t in range(len(x))}


@pytest.mark.parametrize("counts", [1 << 20, 1])
def test_permuted_counts(spark, sized, monkeypatch, counts):
    """Summed in a task first, and sent tile by tile."""
    monkeypatch.setattr(tile, "SOME_COUNTS", counts)
    mats = {"a": random_matrix(3, 12, 40), "b": random_matrix(4, 3, 7)}
    made = tile.tiles(cells_of(spark, mats), 4)
    got = {(r.aln_id, r.perm, r.taxon_idx): list(r.o) for r in tile.permuted_counts(made, 4, 3, 77).collect()}
    assert got == {(a, p, t): brute.matrix_counts(brute.permute(x, 77 + p), 4)[t].astype(int).tolist() for a, x in mats.items() for p in range(3) for t in range(len(x))}
    cells = {(r.aln_id, r.perm, r.taxon_idx, r.col_idx): r.code for r in tile.permuted_cells(made, 3, 77).collect()}
    assert cells == {(a, p, t, j): brute.permute(x, 77 + p)[t, j] for a, x in mats.items() for p in range(3) for t in range(len(x)) for j in range(x.shape[1])}


@pytest.mark.parametrize("scorer", delta.SCORERS)
@pytest.mark.parametrize("sites, taxa, most", [(64, 1024, 1 << 28), (16, 5, 1 << 28), (16, 5, 1)])
def test_site_deltas(spark, monkeypatch, scorer, sites, taxa, most):
    """By tiles, and by cells where the counts are too many for one row; of the matrix and of its permutations."""
    for name, value in (("SITES", sites), ("TAXA", taxa), ("MOST_COUNTS", most)):
        monkeypatch.setattr(tile, name, value)
    mats = {"a": random_matrix(5, 12, 40), "b": random_matrix(6, 8, 20)}
    made = tile.tiles(cells_of(spark, mats), 4)
    nul = null.null_chi2(made, 4, 4)
    ref = null.reference(nul, 20)
    if scorer == "wasserstein_raw":
        ref = ref.drop("q").join(comp.quantiles(nul, 20), "aln_id")
    refs = {r.aln_id: r for r in ref.collect()}
    seen = {(r.aln_id, -1, r.col_idx): r.delta for r in delta.site_deltas(made, 4, scorer, ref, 20).collect()}
    seen |= {(r.aln_id, r.perm, r.col_idx): r.delta for r in delta.null_deltas(made, 4, 2, 9, scorer, ref, 20).collect()}

    def score(chi2, r):
        if scorer in ("squared", "quartic"):
            return float((chi2 if scorer == "squared" else chi2**2).sum())
        z = (chi2 - r.z_mean) / r.z_scale if scorer == "wasserstein" else chi2
        return float(np.abs(np.quantile(z, np.arange(1, 21) / 21) - np.array(r.q)).mean())

    want = {}
    for a, x in mats.items():
        for p in (-1, 0, 1):
            y = x if p < 0 else brute.permute(x, 9 + p)
            o = brute.bump(brute.matrix_counts(y, 4))
            for j in range(x.shape[1]):
                less = o.copy()
                for t in np.flatnonzero(y[:, j] >= 0):
                    less[t, y[t, j]] -= 1
                want[a, p, j] = score(brute.matrix_chi2(o), refs[a]) - score(brute.matrix_chi2(less), refs[a])
    assert seen.keys() == want.keys() and all(np.isclose(seen[k], want[k], atol=1e-8) for k in want)


def test_state_that_one_site_has(spark, sized):
    """Taking the site out leaves expected counts of zero, so every one is one more."""
    x = np.array([[3, 0, 1, 2, 0, 1], [3, 1, 1, 2, 0, 0], [3, 2, 2, 0, 1, 1], [3, 0, 2, 1, 1, 0]], np.int8)
    o = brute.matrix_counts(x, 4)
    less = o.copy()
    less[:, 3] -= 1
    got = {r.col_idx: r.delta for r in delta.site_deltas(tile.tiles(cells_of(spark, {"a": x}), 4), 4).collect()}
    assert (o > 0).all() and np.isclose(got[0], brute.matrix_chi2(o).sum() - brute.matrix_chi2(less).sum())


def logs(got):
    out = {}
    for r in got.log.orderBy("aln_id", "version", "rank").collect():
        out.setdefault(r.aln_id, []).append((r.turn, r.col_idx, r.global_chi2, r.score, r.delta, r.biased, r.p))
    return out


def held(spark, mats, algorithm, most, permutations, top_n, delta_null, recomputes, k=200):
    """The loop over all matrices at once, against each matrix on its own; what happened on the way."""
    got = pruning.prune_tiles(tile.tiles(cells_of(spark, mats), 4), 4, pruning.Settings(algorithm, most, permutations, top_n, delta_null, recomputes), k)
    log, ends = logs(got), {r.aln_id: r for r in got.ends.collect()}
    after, seen = {}, set()
    for r in got.after.orderBy("taxon_idx").collect():
        after.setdefault(r.aln_id, []).append(r.chi2)
    for a, x in mats.items():
        want = brute.prune_matrix(x, 4, algorithm, most, permutations, top_n, delta_null, recomputes)
        mine = log.get(a, [])
        assert [r[:2] for r in mine] == [r[:2] for r in want["log"]], a
        assert np.allclose([[np.nan if v is None else v for v in r] for r in mine], [[np.nan if v is None else v for v in r] for r in want["log"]], atol=1e-7, equal_nan=True)
        assert (ends[a].reason, ends[a].used) == (want["reason"], want["recomputes"]) and np.allclose(after[a], want["after"])
        turns = [r[0] for r in want["log"]]
        seen |= {("renewed", want["recomputes"]), ("back", bool(turns) and set(range(1, max(turns) + 1)) != set(turns)), ("batches", len(set(turns))), ("reason", want["reason"].split(" (")[0])}
    return seen


def biased(seed, taxa=10, sites=60, share=0.45):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (taxa, sites)).astype(np.int8)
    x[0] = np.where(rng.random(sites) < share, 1, x[0])
    return x


def test_loop_goes_back_and_renews(spark):
    seen = held(spark, {f"m{s}": biased(s, 10 + s % 3) for s in range(5)}, "squared", 40, 20, 20, True, 1)
    assert ("renewed", 1) in seen and ("reason", "delta not significant") in seen


def test_loop_without_delta_null(spark):
    """Batches of ten until the alignment is fine or the cap is met; an overshoot is taken back."""
    seen = held(spark, {f"m{s}": biased(s, share=0.3 + 0.05 * s) for s in range(6)}, "squared", 30, 20, 10, False, 1)
    assert ("back", True) in seen and any(k == "batches" and n > 2 for k, n in seen)
    assert ("reason", "alignment p-value") in seen or any(v.startswith("reached") for k, v in seen if k == "reason")


@pytest.mark.parametrize("algorithm", ["quartic", "wasserstein"])
def test_loop_with_other_scores(spark, algorithm):
    held(spark, {f"m{s}": biased(s, 11) for s in range(2)}, algorithm, 6, 20, 3, True, 1, 200)


def test_log_put_together(spark, monkeypatch):
    """Tables of the log put together give the batches that stand, with places from 0 on."""
    monkeypatch.setattr(pruning, "FOLD", 2)
    batches, stats = [], []
    for version, turn, done, cols in ((0, 1, 0, (7, 3)), (1, 2, 2, (9, 1)), (3, 3, 2, (9,)), (4, 4, 3, (1,))):
        rows = [("a", i + 1, c, 0.5, 2.0, 0.0, True, turn, done, version) for i, c in enumerate(cols)]
        batches = pruning._put_together([*batches, spark.createDataFrame(rows, "aln_id string, rank int, col_idx int, delta double, score double, p double, fine boolean, turn int, done long, version int").coalesce(1)])
        stats = pruning._put_together([*stats, spark.createDataFrame([("a", version, 10.0 * version, version)], "aln_id string, version int, total double, biased long").coalesce(1)])
    assert len(batches) == len(stats) == 1
    log = pruning._log(batches, [spark.createDataFrame([("a", 1)], "aln_id string, version int")], stats).collect()
    assert sorted((r.seq, r.turn, r.col_idx, r.global_chi2) for r in log) == [(0, 1, 7, 0.0), (1, 1, 3, 0.0), (2, 3, 9, 30.0), (3, 4, 1, 40.0)]


def test_loop_without_anything_to_do(spark):
    got = pruning.prune_tiles(tile.tiles(cells_of(spark, {"a": biased(1)}), 4), 4, pruning.Settings("squared", 0, 5))
    assert not got.log.collect() and got.ends.first().reason.startswith("reached") and got.before.collect() == got.after.collect()
    seen = held(spark, {"a": biased(1, 10, 3, 1.0)}, "squared", 9, 20, 5, False, 0)
    assert ("reason", "no columns left") in seen or ("reason", "alignment p-value") in seen


def test_unknown_algorithm_and_flat_null(spark):
    made = tile.tiles(cells_of(spark, {"a": np.zeros((4, 5), np.int8)}), 4)
    with pytest.raises(ValueError, match="unknown algorithm"):
        pruning.prune_tiles(made, 4, pruning.Settings("nope"))
    with pytest.raises(ValueError, match="no spread"):
        pruning.prune_tiles(made, 4, pruning.Settings("wasserstein", 5, 5), 20)


def test_folds_of_ones_own():
    delta.register_fold("root", lambda x: x**0.5, "sum")
    try:
        for name, each, merge in (("rank", lambda x: x.argsort(axis=0) * 1.0, "sum"), ("mean", lambda x: x - x.mean(axis=0), "max"), ("root", lambda x: x, "sum"), ("x", lambda x: x, "mean")):
            with pytest.raises(ValueError):
                delta.register_fold(name, each, merge)
    finally:
        del delta.FOLDS["root"]
    with pytest.raises(ValueError, match="unknown scorer"):
        delta.checked("root")


def test_counts_are_not_what_is_sent_to_all_tasks(spark):
    """Totals are one row a matrix; Spark took them for larger than the counts and broadcast those."""
    o = written(spark.range(5000).selectExpr("'a' AS aln_id", "cast(id AS int) AS taxon_idx", "array(id, id + 1, id * 7 % 11, 3L) AS o"), "counts")
    plan = comp.fudged(o, 4)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_a_tile_meets_its_own_taxa_only(spark):
    n = tile.TAXA + 500
    f = spark.range(n).selectExpr("'a' AS aln_id", "cast(id AS int) AS taxon_idx", "array(id, 1L, 2L, 3L) AS o", f"array({n * (n - 1) // 2}L, {n}L, {2 * n}L, {3 * n}L) AS tc")
    got = {r["of_block"]: np.frombuffer(r["counts"], np.int32).reshape(-1, 4) for r in tile._own(f, 4).collect()}
    assert {k: len(v) for k, v in got.items()} == {0: tile.TAXA, 1: 500}
    assert (np.concatenate([got[0], got[1]])[:, 0] == np.arange(n)).all()


def test_a_task_orders_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100)
    made = tables._dealt(spark.range(1000).selectExpr("id % 97 AS k", "id AS i"), "k")
    ranked = made.selectExpr("k", "row_number() OVER (PARTITION BY k ORDER BY i) AS i")
    assert ranked.rdd.getNumPartitions() == 11


def test_cells_are_the_same_whether_taxa_are_sent_or_dealt(spark, monkeypatch):
    letters = spark.range(600).selectExpr("'a' AS aln_id", "id % 50 AS taxon_id", "cast(id div 50 AS int) AS col_idx", "substr('ACGT-', cast(id % 5 + 1 AS int), 1) AS residue")
    want = sorted(map(tuple, tables.cells(letters, "ACGT").collect()))
    monkeypatch.setattr(tables, "ROWS", 100)
    monkeypatch.setattr(tables, "SENT", 10)
    got = tables.cells(letters, "ACGT")
    assert len(want) == 600 and sorted(map(tuple, got.collect())) == want
    assert len(got.inputFiles()) == 7


def test_half_a_million_taxa_are_sent_to_the_letters(spark, monkeypatch):
    """Dealing letters out to many partitions holds all of a task's letters in memory."""
    letters = spark.range(540_000).selectExpr("'a' AS aln_id", "id AS taxon_id", "0 AS col_idx", "substr('ACGT', cast(id % 4 + 1 AS int), 1) AS residue")
    monkeypatch.setattr(type(letters), "repartition", None)
    got = tables.cells(letters, "ACGT")
    assert got.agg({"taxon_idx": "max"}).first()[0] == 539_999 and got.filter("code <> taxon_idx % 4").isEmpty()


def test_many_quantiles_cost_a_value_no_more(spark):
    """Exact at 200 positions, and the plan of 200 is no longer than that of 20 but for the list of positions."""
    rng = np.random.default_rng(13)
    groups = {"one": rng.normal(size=1), "two": rng.normal(size=2), "ties": rng.integers(0, 3, 7) * 1.0, "even": rng.normal(size=202), "many": rng.normal(size=3000)}
    made = ranks.ranked(spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double"), ["g"], "v")
    asked = {k: ranks.at_positions(made, ["g"], "v", comp.positions(k)) for k in (20, 200)}
    for k, df in asked.items():
        got = {r.g: r.q for r in df.collect()}
        assert all(np.allclose(got[g], np.quantile(x, comp.positions(k)), atol=1e-12) for g, x in groups.items())
    floors = {k: df._jdf.queryExecution().optimizedPlan().toString().lower().count("floor") for k, df in asked.items()}
    assert floors[20] == floors[200]


@pytest.mark.parametrize("wide", [1 << 19, 100])
def test_columns_hold_all_taxa(spark, monkeypatch, wide):
    """A row of counts meets as many tiles of few sites however many blocks of taxa the matrix had."""
    for name, value in (("SITES", 16), ("TAXA", 5), ("WIDE", wide), ("LEAST", 4)):
        monkeypatch.setattr(tile, name, value)
    mats = {"a": random_matrix(5, 12, 40), "b": random_matrix(6, 3, 7)}
    got = tile.columns(tile.tiles(cells_of(spark, mats), 4), 4).collect()
    assert len(got) == (4 if wide > 100 else 6)
    for name, x in mats.items():
        seen = {}
        for r in [r for r in got if r.aln_id == name]:
            assert r.taxa == r.total_taxa == len(x) and r.first_taxon == 0
            codes, gone = np.frombuffer(r.data, np.int8).reshape(len(x), -1), np.frombuffer(r.gone, np.int64).reshape(-1, 4)
            for i, j in enumerate(np.frombuffer(r.sites, np.int32)):
                seen[int(j)] = codes[:, i].tolist(), gone[i].tolist()
        assert seen == {j: (x[:, j].tolist(), [int((x[:, j] == c).sum()) for c in range(4)]) for j in range(x.shape[1])}
