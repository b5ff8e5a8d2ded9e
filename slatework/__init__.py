"""Evidence retrieval, evaluation and text processing on Spark DataFrames."""
