"""Scan operators: pure functions from DataFrame to DataFrame, and the page fold."""
