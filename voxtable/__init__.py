"""Sparse 3-D volume analytics on Spark DataFrames."""
