"""Dimensional time-series analytics on Spark DataFrames."""
