"""Composition of alignments whose taxa keep coming: counts held as streaming state, scores from any snapshot of them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import composition as comp


def running_counts(cells: DataFrame, n_states: int) -> DataFrame:
    """(aln_id, taxon_idx, o) of a streaming DataFrame of cells; counts add up, so complete and update mode both work.

    The state is one row of counts a taxon, however many cells it has had.
    """
    return comp.counts(cells, n_states)


def scores_of(snapshot: DataFrame, n_states: int) -> DataFrame:
    """(aln_id, taxon_idx, chi2) of the counts that a complete-mode sink holds, or of one batch of it in foreachBatch."""
    return comp.chi2_of(snapshot, n_states)
