"""Vector search and document retrieval on Spark DataFrames."""
