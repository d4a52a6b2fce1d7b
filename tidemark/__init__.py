"""Tidemark: robust price references over Spark DataFrames, and tools for large text corpora."""

__version__ = "0.1.0"
