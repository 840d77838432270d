"""Dense N-dimensional array streams as Spark DataFrames."""
