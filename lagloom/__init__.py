"""Lagged-dependency analytics on Spark DataFrames."""
