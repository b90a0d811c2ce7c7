"""Operators that prepare text for training: each takes and returns DataFrames."""
