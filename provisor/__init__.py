"""Bulk label and ingredient-catalog analytics on Spark DataFrames."""
