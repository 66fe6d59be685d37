"""Checks: DataFrames in, DataFrames of evidence out."""
