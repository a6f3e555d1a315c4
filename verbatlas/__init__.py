"""Corpus analytics operators for Spark: every function takes and returns DataFrames."""
