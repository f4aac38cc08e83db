"""Operators on DataFrames: chunking, indexing, retrieval, answers and evaluation."""
