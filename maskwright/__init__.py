"""Sensitive-data detection, pseudonymisation and text analytics on Spark DataFrames."""
