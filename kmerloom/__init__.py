"""Sequence sketching and classification on Spark DataFrames."""
