"""Comparison of two DataFrames."""
