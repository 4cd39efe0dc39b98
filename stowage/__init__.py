"""Stowage: archive analytics on Spark DataFrames."""
