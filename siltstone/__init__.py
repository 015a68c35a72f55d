"""Batch analytics over text corpora and detection tables, built on Spark DataFrames."""

__version__ = "0.1.0"
