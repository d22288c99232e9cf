"""Table cleaning, semantic typing and record linkage on Spark DataFrames."""
