"""Operators on concept, edge and issue DataFrames."""
