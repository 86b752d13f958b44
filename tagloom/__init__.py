"""Tag-lens analytics over points of interest, on Spark DataFrames."""
