"""statloom: statistical analytics on Spark DataFrames."""
