"""Bitemporal environmental analytics on Spark DataFrames."""
