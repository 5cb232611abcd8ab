"""Training-data operators: each module is one operator over plain DataFrames.

Nothing outside this subpackage imports it.
"""
