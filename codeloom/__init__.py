"""Code-intelligence analytics on Spark DataFrames."""
