"""Listings analytics on Spark: DataFrame-in, DataFrame-out jobs."""
