"""Reaction-network analytics and data preparation as plain Spark DataFrames."""
