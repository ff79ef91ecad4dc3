"""Prose analytics on Spark DataFrames."""
