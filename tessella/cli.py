"""Command line: `python -m tessella.cli test|prune --file PATH [...]`."""

from __future__ import annotations

import argparse
import os
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .plans import analyses
from .sources import report
from .sources.files import FORMATS, read_alignment
from .sources.shared import written


def arguments(argv=None) -> argparse.Namespace:
    # The names and defaults of the flags.
    top = argparse.ArgumentParser(prog="tessella", description="Compositional bias of alignments.")
    top.add_argument("--version", action="version", version=version())
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("test", "prune"):
        p = sub.add_parser(name)
        p.add_argument("--file", required=True)
        p.add_argument("--format", default="fasta", choices=sorted(FORMATS))
        p.add_argument("--permutations", type=int, default=100)
        # Taken so that known command lines run; Spark deals out the work.
        p.add_argument("--num_workers_permute", type=int, default=1, help="no effect")
        if name == "test":
            p.add_argument("--create_output", action="store_true")
        else:
            p.add_argument("--max_residue_pruned", type=int, default=100)
            p.add_argument("--top_n", type=int, default=1)
            p.add_argument("--num_workers_chisq", type=int, default=1, help="no effect")
            p.add_argument("--pruning_algorithm", default="wasserstein", choices=analyses.ALGORITHMS)
            p.add_argument("--delta-null", action=argparse.BooleanOptionalAction, default=True)
    return top.parse_args(argv)


def version() -> str:
    """Name, version and, in a checkout, the commit."""
    got = subprocess.run(["git", "-C", str(Path(__file__).parent), "rev-parse", "--short", "HEAD"], capture_output=True, text=True) if shutil.which("git") else None
    return f"tessella {__version__}" + (f" ({got.stdout.strip()})" if got and got.returncode == 0 else "")


def main(argv=None, spark: SparkSession | None = None) -> list[str]:
    """Run a command; returns the paths of the files made, which are on the file system of the alignment's path."""
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    taxa = read_alignment(spark, a.file, a.format)
    stem = os.path.splitext(a.file)[0]
    if a.command == "test":
        scores = written(analyses.composition_test(taxa, a.permutations), "scores")
        n = scores.agg(F.count("*").alias("n"), F.count_if("biased").alias("biased")).first()
        print(f"{n['biased']} of {n['n']} taxa are biased")
        shown = scores.orderBy(F.abs("z").desc(), "taxon_idx").select("taxon_id", F.format_string("%.4f", "p"), F.format_string("%.2f", "z"))
        for r in (shown.limit(5) if a.create_output else shown).toLocalIterator():
            print(*r, sep="\t")
        return [report.write_scores(scores, f"{stem}_scores.tsv")] if a.create_output else []
    out = written(analyses.prune(taxa, a.pruning_algorithm, a.max_residue_pruned, a.permutations, a.top_n, a.delta_null), "pruned")
    kind = lambda k: out.filter(F.col("kind") == k)
    name = f"{stem}_{a.pruning_algorithm}_s{a.top_n}_pruned"
    made = [
        report.write_fasta(kind("sequence"), f"{name}.fasta"),
        report.write_log(kind("log"), f"{name}.tsv"),
        report.write_changes(kind("score"), f"{name}_scores.tsv"),
        report.write_score_json(out, f"{name}_score_dict.json", a.pruning_algorithm, __version__),
    ]
    # A parameter bounds the batches and the summary.
    batches = kind("log").groupBy("iteration").agg(F.count("*").alias("n"), F.first("global_chi2").alias("chi2"), F.first("significant_taxa").alias("biased")).orderBy("iteration")
    removed = 0
    for r in batches.toLocalIterator():
        removed += r["n"]
        print(f"batch {r['iteration']}: {removed} columns removed, chi-squared {r['chi2']:.2f}, {r['biased']} biased taxa")
    for r in analyses.run_summary(out).toLocalIterator():
        print(f"chi-squared {r['chi2_before']:.2f} (p {r['p_before']:.3f}) before, {r['chi2_after']:.2f} (p {r['p_after']:.3f}) after; the null's from {r['null_least']:.2f} to {r['null_most']:.2f}")
        print(f"largest |Z| {r['z_before']:.2f} before, {r['z_after']:.2f} after; {r['biased_after']} biased taxa left; null renewed {r['recomputes']} times; stop: {r['reason']}")
    return made


if __name__ == "__main__":
    main()
