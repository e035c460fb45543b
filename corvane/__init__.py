"""corvane: retrieval analytics over Spark DataFrames."""
