"""Operators over DataFrames: groups, pairs, covers and comparisons."""
