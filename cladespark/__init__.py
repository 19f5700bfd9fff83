"""Distance-based phylogenetics and sequence analytics on Spark DataFrames."""
