"""Leakage-aware temporal validation and corpus operators on Spark DataFrames."""
