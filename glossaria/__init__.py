"""Localization-catalog analytics on Spark DataFrames."""
