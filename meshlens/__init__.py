"""Service-graph analytics on Spark DataFrames."""

__version__ = "0.3.0"
