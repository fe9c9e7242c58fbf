"""Labelled time-series analytics expressed as Spark DataFrames."""
