"""Operators for large training-text corpora, expressed on Spark DataFrames."""
