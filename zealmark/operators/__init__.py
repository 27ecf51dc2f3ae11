"""Operators: each takes and returns DataFrames made of built-in Spark functions."""
