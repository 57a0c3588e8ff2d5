"""Word-history analytics on Spark DataFrames."""
