"""Column and value functions."""
