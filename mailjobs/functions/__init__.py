"""Functions over columns."""
