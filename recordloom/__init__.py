"""Set-at-a-time engine for knowledge records on Spark DataFrames."""
