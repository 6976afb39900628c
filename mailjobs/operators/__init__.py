"""Operators over DataFrames. Time is an argument, ties are broken by stated columns."""
