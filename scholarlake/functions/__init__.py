"""Column and ranking helpers."""
