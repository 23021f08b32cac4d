"""Survey, mesh and model analytics on Spark DataFrames."""
