"""Readers of sale and census files, and writers with upsert semantics."""
