"""Road-incident analytics on Spark DataFrames."""
