"""Column functions: byte sizes and times."""
