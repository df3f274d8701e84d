"""Claims analytics on Spark: DataFrame-in, DataFrame-out operators."""

__version__ = "0.1.0"
