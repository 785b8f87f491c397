"""Operators over corpora of text and source code, as functions from DataFrames to DataFrames."""
