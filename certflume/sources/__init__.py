"""Readers for landed files: log lists, pages, tiles, tree heads, state."""
