"""Alignments from tables and files, and report writers."""
