"""Whole analyses made of the operators."""
