"""Text retrieval and ranking on Spark DataFrames."""
