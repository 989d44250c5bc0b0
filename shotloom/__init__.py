"""Frame-stream analytics on Spark DataFrames."""
