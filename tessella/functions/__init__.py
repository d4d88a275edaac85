"""Alphabets and column expressions."""
