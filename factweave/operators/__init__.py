"""Operators on DataFrames; every one is lazy unless its docstring says otherwise."""
