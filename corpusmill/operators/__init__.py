"""Operators on DataFrames of files, chunks, questions and results."""
