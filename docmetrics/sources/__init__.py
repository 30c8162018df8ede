"""Readers, the source scan, and writers."""
