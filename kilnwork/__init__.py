"""kilnwork: trajectory and training-data analytics on Spark DataFrames."""
