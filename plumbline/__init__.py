"""Plumbline: checks of recorded time series and honest uncertainty, on Spark DataFrames."""
