"""Column builders: scalar parsing, rolling windows, recursive averages."""
