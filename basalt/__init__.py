"""Basalt: a warehouse-style analytics engine on Spark DataFrames."""
