"""Floor-plan analytics on Spark DataFrames."""
