"""Stored queries: parameters, columns and a list of steps whose expressions are Spark SQL."""
