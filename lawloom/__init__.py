"""Equational-law analytics on Spark DataFrames."""
