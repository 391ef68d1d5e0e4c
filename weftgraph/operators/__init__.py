"""Frontier operators and graph algorithms on DataFrames."""
