"""docframe: document data on Spark DataFrames (see README.md)."""

__version__ = "0.1.0"
