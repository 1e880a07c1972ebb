"""Kinograph: spatio-temporal interaction analytics on Spark DataFrames."""
