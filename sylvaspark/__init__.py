"""Conditional-inference analytics on Spark DataFrames."""
