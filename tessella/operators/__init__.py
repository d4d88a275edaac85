"""Relational operators over cells (aln_id, taxon_idx, col_idx, code)."""
