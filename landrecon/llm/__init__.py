"""Operators of a training-data pipeline on Spark DataFrames. Nothing outside this package imports it."""
