"""The query catalogue: the operators on the driver's tables, each with its DuckDB oracle."""
