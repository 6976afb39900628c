"""Structured Streaming jobs, with batch twins of the stateful ones."""
