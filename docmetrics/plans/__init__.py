"""Whole reports: page assembly, and the query catalogue over the given tables."""
