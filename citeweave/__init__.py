"""Citation analytics as Spark DataFrames."""
