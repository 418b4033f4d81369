"""Debounced rebuilds from a stream of file changes."""
