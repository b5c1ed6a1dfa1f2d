"""A relational layer over Spark DataFrames."""
