"""Operators: DataFrames in, DataFrames out, for all repositories at once."""
