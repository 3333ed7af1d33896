"""A graph-pattern analytics engine on Spark DataFrames."""
