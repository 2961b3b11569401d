"""Spread, margin and panel-econometrics operators on Spark DataFrames."""
