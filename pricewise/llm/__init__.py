"""Operators of a training-data pipeline over a table of documents.

Nothing else in the library imports this subpackage. Each operator is a
function from DataFrames to DataFrames with its own options and outputs;
``registry`` holds the thin registered queries and their SQL.
"""
