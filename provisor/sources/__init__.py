"""Readers: fixed schemas, nothing is inferred."""
