"""Operators as functions from DataFrames to DataFrames; no actions inside but where a docstring says so."""
