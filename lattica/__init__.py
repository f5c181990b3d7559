"""Spatial, sequence and corpus analytics on Spark DataFrames."""
