"""Grammar-guided graph closure on Spark DataFrames."""
