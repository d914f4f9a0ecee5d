"""A retail analytics engine on Spark DataFrames."""
