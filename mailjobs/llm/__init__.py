"""Operators for large-scale training-data work: one module for each operator.

Nothing else in the library imports this package; deleting the folder leaves the rest working.
"""
