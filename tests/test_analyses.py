"""Pure-function goldens and edge cases of the analyses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import composition as comp
from tessella.operators import tiles as tile
from tessella.plans import analyses
from tessella.sources import files, report

from . import brute as an


def naive(x, n, score):
    o = an.bump(an.matrix_counts(x, n))
    base, out = score(an.matrix_chi2(o)), []
    for j in range(x.shape[1]):
        less = o.copy()
        for t in range(len(x)):
            if x[t, j] >= 0:
                less[t, x[t, j]] -= 1
        out.append(base - score(an.matrix_chi2(less)))
    return np.array(out)


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 4, (12, 90)).astype(np.int8)
    x[0] = np.where(rng.random(90) < 0.6, 2, x[0])
    return x


def test_biased_taxon_is_found_and_pruned(matrix):
    chi2 = an.matrix_chi2(an.matrix_counts(matrix, 4))
    assert chi2.argmax() == 0
    got = an.prune_matrix(matrix, 4, "squared", 20, 30, 4)
    cols = [r[1] for r in got["log"]]
    assert len(set(cols)) == len(cols) and not set(cols) & set(got["alive"].tolist())
    assert len(cols) + len(got["alive"]) == 90 and got["after"].sum() <= got["before"].sum()


def test_cap_and_zero_cap(matrix):
    got = an.prune_matrix(matrix, 4, "squared", 5, 20, 3, delta_null=False)
    assert len(got["log"]) <= 5 + 3 - 1
    none = an.prune_matrix(matrix, 4, "squared", 0, 20)
    assert not none["log"] and len(none["alive"]) == 90


def test_unknown_algorithm(matrix):
    with pytest.raises(ValueError, match="unknown algorithm"):
        an.prune_matrix(matrix, 4, "nope")


def test_zero_spread_is_an_error():
    with pytest.raises(ValueError, match="no spread"):
        an.Null(np.zeros((4, 5), np.int8), 4, 5, "wasserstein", False)


def test_robust_z_without_spread():
    pool = np.ones(9)
    assert an.robust(np.array([1.0, 2.0, 0.0]), pool).tolist() == [0.0, np.inf, -np.inf]


def test_p_values_in_range():
    p = an.corrected(np.array([0.0, 5.0, 99.0]), np.arange(10.0))
    assert (p >= 0).all() and (p <= 1).all() and p[2] == 0


NEXUS = """#NEXUS
[a comment]
begin data; dimensions ntax=3 nchar=8; format datatype=dna gap=- missing=? matchchar=. interleave;
matrix
one ACGT
two ...A
'thr ee' --.T

one AAAA
two C...
'thr ee' GGGG
;
end;"""


def test_parsers_agree():
    rows = [("one", "ACGTAAAA"), ("two", "ACGACAAA"), ("thr ee", "--GTGGGG")]
    assert files.parse_nexus(NEXUS) == rows
    plain = [(n.replace(" ", "_"), s) for n, s in rows]
    assert an.parse_fasta("".join(f">{n} x\n{s[:4]}\n{s[4:]}\n" for n, s in plain)) == plain
    assert files.parse_phylip("3 8\n" + "".join(f"{n} {s}\n" for n, s in plain)) == plain
    assert files.parse_stockholm("# STOCKHOLM 1.0\n" + "".join(f"{n} {s}\n" for n, s in plain) + "//\n") == plain
    assert files.parse_clustal("CLUSTAL W\n\n" + "".join(f"{n} {s}\n" for n, s in plain) + "   ***\n") == plain


def test_nexus_wrapped_and_checked():
    head = "#NEXUS\nbegin data; dimensions ntax={} nchar={}; format datatype=dna gap=-;\nmatrix\n"
    rows = [("one", "ACGTAAAA"), ("two", "GGGGCCCC")]
    assert files.parse_nexus(head.format(2, 8) + "one ACGT\n AAAA\ntwo GGGG\nCCCC\n;end;") == rows
    assert files.parse_nexus(head.format(2, 8) + "one\nACGT\nAAAA\ntwo GGGG CCCC\n;end;") == rows
    for ntax, nchar, body in ((2, 9, "one ACGTAAAA\ntwo GGGGCCCC"), (3, 8, "one ACGTAAAA\ntwo GGGGCCCC"), (2, 4, "a ACGT\na GGGG")):
        with pytest.raises(ValueError):
            files.parse_nexus(head.format(ntax, nchar) + body + "\n;end;")


def test_phylip_sequential_and_interleaved():
    rows = [("one", "ACGTAAAA"), ("two", "GGGGCCCC")]
    assert files.parse_phylip("2 8\none ACGT\nAAAA\ntwo GGGG\nCCCC\n") == rows
    assert files.parse_phylip("2 8\none ACGT\ntwo GGGG\n\nAAAA\nCCCC\n") == rows
    with pytest.raises(ValueError):
        files.parse_phylip("2 8\none ACGT\ntwo GGGG\n")


@pytest.mark.parametrize("parse, head", [(files.parse_clustal, "CLUSTAL W\n\n"), (files.parse_stockholm, "# STOCKHOLM 1.0\n")])
def test_taxon_twice_in_a_block_raises(parse, head):
    assert parse(head + "a ACGT\nb AC-T\n\na GG\nb CC\n") == [("a", "ACGTGG"), ("b", "AC-TCC")]
    with pytest.raises(ValueError, match="occurs twice"):
        parse(head + "a ACGT\na GGGG\n")


def test_alignment_without_any_state_raises(spark):
    taxa = spark.createDataFrame([("a", 0, "x", "----"), ("a", 1, "y", "NNNN")], files.SCHEMA)
    with pytest.raises(ValueError, match="no state"):
        analyses.composition_test(taxa, 3)


def test_rollback_and_renewal():
    """A large batch overshoots: it is taken back once, the null is renewed once, and later batches are a tenth."""
    rng = np.random.default_rng(11)
    seen = set()
    for seed in range(12):
        x = np.random.default_rng(seed).integers(0, 4, (10, 60)).astype(np.int8)
        x[0] = np.where(rng.random(60) < 0.45, 1, x[0])
        got = an.prune_matrix(x, 4, "squared", 40, 20, 20)
        sizes = [sum(r[0] == i for r in got["log"]) for i in sorted({r[0] for r in got["log"]})]
        cols = [r[1] for r in got["log"]]
        assert len(set(cols)) == len(cols) and sorted({*cols, *got["alive"].tolist()}) == list(range(60))
        assert got["recomputes"] <= 1 and all(n <= 20 for n in sizes)
        seen |= {("renewed", got["recomputes"]), ("small", bool(sizes) and max(sizes[1:] or [0]) <= 2), ("reason", got["reason"].split(" (")[0])}
    assert ("renewed", 1) in seen and ("small", True) in seen and ("reason", "delta not significant") in seen
    never = an.prune_matrix(x, 4, "squared", 40, 20, 20, recomputes=0)
    assert never["recomputes"] == 0


def test_running_counts_of_a_stream(spark, tmp_path):
    from tessella import streaming

    for part in ([(0, 0, 1), (1, 0, 2)], [(0, 1, 1), (1, 1, -1), (2, 0, 3)]):
        spark.createDataFrame([("a", *r) for r in part], "aln_id string, taxon_idx int, col_idx int, code int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("aln_id string, taxon_idx int, col_idx int, code int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streaming.running_counts(stream, 4).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.table("running")
    assert {r.taxon_idx: r.o for r in got.collect()} == {0: [0, 2, 0, 0], 1: [0, 0, 1, 0], 2: [0, 0, 0, 1]}
    want = an.matrix_chi2(an.bump(np.array([[0, 2, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], float)))
    assert np.allclose([r.chi2 for r in streaming.scores_of(got, 4).orderBy("taxon_idx").collect()], want)


def test_ragged_file_raises(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x\nACGT\n>y\nAC\n")
    with pytest.raises(Exception, match="unequal length"):
        files.read_alignment(spark, str(tmp_path / "a.fasta")).collect()


def test_cli_writes_reports(spark, tmp_path):
    from tessella import cli

    rng = np.random.default_rng(7)
    text = "".join(f">t{i}\n{''.join(rng.choice(list('ACGT'), 60, p=[.7, .1, .1, .1] if i == 0 else [.25] * 4))}\n" for i in range(6))
    (tmp_path / "a.fasta").write_text(text)
    made = cli.main(["prune", "--file", str(tmp_path / "a.fasta"), "--permutations", "10", "--max_residue_pruned", "4", "--pruning_algorithm", "squared"], spark)
    assert [p.rsplit("_s1", 1)[-1] for p in made] == ["_pruned.fasta", "_pruned.tsv", "_pruned_scores.tsv", "_pruned_score_dict.json"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted([p.rsplit("/", 1)[-1] for p in made] + ["a.fasta"])
    x = np.array([["ACGT".index(c) for c in line] for line in text.split("\n")[1::2]], np.int8)
    want = an.prune_matrix(x, 4, "squared", 4, 10)
    log = [line.split("\t") for line in (tmp_path / made[1]).read_text().splitlines()]
    assert log[0] == report.LOG_HEADER and [(int(r[0]), int(r[1])) for r in log[1:]] == [r[:2] for r in want["log"]]
    assert want["log"] and np.allclose([[float(v) for v in r[2:7]] for r in log[1:]], [r[2:7] for r in want["log"]]) and {r[7] for r in log[1:]} == {"squared"}
    rows = an.parse_fasta((tmp_path / made[0]).read_text())
    assert rows == [(f"t{i}", "".join("ACGT"[x[i, j]] for j in want["alive"])) for i in range(6)]
    changes = [line.split("\t") for line in (tmp_path / made[2]).read_text().splitlines()]
    z = an.robust(want["before"], want["null"].pool)
    assert changes[0] == report.CHANGE_HEADER and [r[0] for r in changes[1:]] == [f"t{i}" for i in sorted(range(6), key=lambda i: (-z[i], i))]
    assert np.allclose([float(r[1]) for r in changes[1:]], sorted(z, reverse=True))
    whole = report.read_json(spark, made[3])
    row = whole.first()
    assert (row["schema_version"], row["algorithm"], row["stop_reason"], row["null_recomputes"]) == (3, "squared", want["reason"], want["recomputes"])
    assert np.allclose(row["before_permuted"], want["null"].table) and np.allclose(row["after_real"], want["after"])
    assert row["taxa"] == [f"t{i}" for i in range(6)] and len(row["before_permuted"]) == 10 and len(row["null_max_deltas"]) == 10
    assert all(len(v) == 6 for v in [row["before_real"], row["after_real"], *row["before_permuted"]])
    bins = comp.histogram(report.distributions(whole), 4, keys=("kind",))
    assert {r["kind"]: r["n"] for r in bins.groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {"before_real": 6, "after_real": 6, "before_permuted": 60}
    assert cli.arguments(["prune", "--file", "x", "--num_workers_chisq", "3", "--num_workers_permute", "2"]).top_n == 1
    made = cli.main(["test", "--file", f"file://{tmp_path}/a.fasta", "--permutations", "10", "--create_output"], spark)
    assert made == [f"file://{tmp_path}/a_scores.tsv"]
    lines = (tmp_path / "a_scores.tsv").read_text().splitlines()
    order = sorted(range(6), key=lambda i: (-abs(z[i]), i))
    p = an.corrected(want["before"], want["null"].pool)
    assert lines == ["Row\tEmpirical-Pvalue\tZ-Score", *(f"t{i}\t{p[i]:.4f}\t{z[i]:.2f}" for i in order)]


def test_lines_are_written_whole_and_in_order(spark, tmp_path):
    from tessella.sources.sinks import write_lines

    df = spark.range(5000).selectExpr("id", "concat('line ', id, ' é') AS line").repartition(7)
    path = f"file://{tmp_path}/x.txt"
    for n in (5000, 3):  # the second replaces the first
        assert write_lines(df.filter(F.col("id") < n), path, ["id"], "head") == path
        assert (tmp_path / "x.txt").read_text() == "head\n" + "".join(f"line {i} é\n" for i in range(n))
    write_lines(df.filter("id < 0"), path, ["id"])
    assert (tmp_path / "x.txt").read_text() == "" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.txt"]


def test_run_summary(spark):
    taxa = spark.createDataFrame([("a", i, f"t{i}", "".join(np.random.default_rng(i).choice(list("ACGT"), 50, p=[.7, .1, .1, .1] if i == 0 else [.25] * 4))) for i in range(6)], files.SCHEMA)
    x = np.array([["ACGT".index(c) for c in r.seq] for r in taxa.orderBy("taxon_idx").collect()], np.int8)
    want = an.prune_matrix(x, 4, "squared", 2, 10)
    got = analyses.run_summary(analyses.prune(taxa, "squared", 2, 10)).first()
    first = want["null"]
    assert np.allclose([got[c] for c in ("chi2_before", "chi2_after", "null_least", "null_most", "p_before", "p_after", "z_before", "z_after")], [want["before"].sum(), want["after"].sum(), first.sums.min(), first.sums.max(), first.p_of(want["before"].sum()), first.p_of(want["after"].sum()), np.abs(an.robust(want["before"], first.pool)).max(), np.abs(an.robust(want["after"], first.pool)).max()])
    assert (got["removed"], got["reason"], got["recomputes"], got["biased_after"]) == (len(want["log"]), want["reason"], want["recomputes"], int((want["after"] > first.tau).sum()))


def test_prune_without_any_removal(spark):
    taxa = spark.createDataFrame([("a", i, f"t{i}", "ACGT" * 10) for i in range(4)] + [("b", i, f"t{i}", "ACGTTGCA"[i:] + "ACGTTGCA"[:i]) for i in range(4)], files.SCHEMA)
    got = analyses.prune(taxa, "squared", 5, 10).collect()
    assert not [r for r in got if r["kind"] == "log"] and len([r for r in got if r["kind"] == "sequence"]) == 8


def test_one_batch_of_a_biased_alignment(spark):
    """Against a recount of every removal, on a protein alignment with one taxon of another composition."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (8, 40))
    x[0] = np.where(rng.random(40) < 0.8, rng.integers(0, 3, 40), x[0])
    cells = spark.createDataFrame([("a", t, j, int(x[t, j])) for t in range(8) for j in range(40)], "aln_id string, taxon_idx int, col_idx int, code int")
    got = sorted(analyses.one_batch(tile.tiles(cells, 20), 20, 6, 20).collect(), key=lambda r: r["rank"])
    d = naive(x, 20, lambda c: float(c.sum()))
    order = sorted(range(40), key=lambda j: (-round(d[j], 9), j))[:6]
    assert got and [r["col_idx"] for r in got] == order[: len(got)]
    assert np.allclose([r["delta"] for r in got], d[order[: len(got)]])
    kept = np.delete(x, order[: len(got)], axis=1)
    before, after = (float(an.matrix_chi2(an.bump(an.matrix_counts(y, 20))).sum()) for y in (x, kept))
    assert np.allclose([got[0]["initial_score"], got[0]["global_chi2"]], [before, after])


def test_density_works_out_its_values_once(spark):
    """What is read twice, behind a filter, comes from a table and not from the values' own plan."""
    from tessella.operators import composition as comp

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return float(i % 17 + 1)

    values = spark.range(200).select(F.lit("a").alias("aln_id"), value("id").alias("chi2"))
    assert comp.density(values, 8).count() == 8 and seen.value == 200


def test_prune_makes_only_the_kinds_asked_for(spark, monkeypatch):
    """The log alone is the log of the whole, and the scores' ranks are not worked out for it."""
    x = np.random.default_rng(4).integers(0, 4, (6, 40)).astype(np.int8)
    x[0] = np.where(np.arange(40) % 4 > 0, 0, x[0])
    taxa = spark.createDataFrame([("a", i, f"t{i}", "".join("ACGT"[c] for c in r)) for i, r in enumerate(x)], files.SCHEMA)
    monkeypatch.setattr(analyses, "scores", lambda got: pytest.fail("scores were worked out"))
    got = analyses.prune(taxa, "squared", 2, 10, delta_null=False, kinds=("log", "sequence")).collect()
    want = an.prune_matrix(x, 4, "squared", 2, 10, delta_null=False)
    assert {r.kind for r in got} <= {"log", "sequence"} and sum(r.kind == "sequence" for r in got) == 6
    assert [r.original_index for r in sorted((r for r in got if r.kind == "log"), key=lambda r: r.seq)] == [r[1] for r in want["log"]] != []


def test_prune_log_full_goes_on_to_its_own_end(spark, tmp_path):
    """No cap ends the query: the log has every site that a recount of the whole loop takes out."""
    import pandas as pd

    from tessella import registry
    from tessella.functions.alphabet import PROTEIN

    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, (10, 60)).astype(np.int8)
    x[0] = np.where(rng.random(60) < 0.8, rng.integers(0, 2, 60), x[0])
    x[1] = np.where(rng.random(60) < 0.8, rng.integers(5, 7, 60), x[1])
    pd.DataFrame({"item_id": np.arange(10), "text": ["".join(PROTEIN[c] for c in r) for r in x]}).to_parquet(tmp_path / "benchmark.parquet")
    want = an.prune_matrix(x, 20, most=10**6, top_n=10)
    got = registry.QUERIES["prune_log_full"](spark, str(tmp_path)).orderBy("seq").collect()
    assert len(want["log"]) > 30 and want["reason"].startswith("delta not significant")
    assert [(r.seq, r.iteration, r.original_index) for r in got] == [(i, w[0], w[1]) for i, w in enumerate(want["log"])]
    assert np.allclose([(r.global_chi2, r.initial_score, r.delta, r.significant_taxa, r.null_p) for r in got], [w[2:] for w in want["log"]])
