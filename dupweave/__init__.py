"""dupweave: duplicate-region analytics on Spark DataFrames."""
