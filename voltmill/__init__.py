"""voltmill: board power-distribution analytics and record linkage on Spark DataFrames."""
