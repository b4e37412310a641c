"""Relational operators: each takes DataFrames and column names, returns DataFrames."""
