"""Steps, joins, groups, windows, set operations, request-log profiling and page reading, from DataFrames to DataFrames."""
