"""Operators over connection logs: DataFrames in, DataFrames out."""
