"""Code-and-documentation traceability analytics on Spark DataFrames."""

__version__ = "0.1.0"
