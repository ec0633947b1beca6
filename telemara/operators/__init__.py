"""Operators by group: every one takes DataFrames and returns a DataFrame (or a small fitted model)."""
