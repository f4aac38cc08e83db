"""Document retrieval, grounded answering and evaluation as Spark DataFrames."""
