"""Table reconciliation, quality and load toolkit on Spark DataFrames."""

__version__ = "0.1.0"
