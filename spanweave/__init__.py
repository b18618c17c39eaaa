"""Temporal performance analytics and corpus processing on Spark DataFrames."""
