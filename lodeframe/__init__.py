"""Analytics operators over typed collections, written for PySpark."""
