"""Depth-camera analytics on Spark DataFrames."""
