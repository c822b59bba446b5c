"""Behavioural analytics over event tables, composed from Spark DataFrames."""
