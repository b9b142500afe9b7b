"""Mesh and graph analytics on Spark DataFrames."""
