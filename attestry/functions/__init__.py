"""Column and SQL functions."""
