"""Tidemark: daily time-series research on Spark DataFrames."""
