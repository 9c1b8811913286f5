"""The query algebra over Spark DataFrames."""
