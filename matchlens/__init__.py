"""Descriptive aggregation of matched event/control evidence on Spark DataFrames."""

__version__ = "1.0.0"
