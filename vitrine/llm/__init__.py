"""Operators for large text-training corpora, each a Spark job over plain DataFrames."""
