"""Relational operators: each takes DataFrames and columns and returns a lazy DataFrame."""
