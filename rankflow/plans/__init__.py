"""Bindings of the operators to the driver's test tables, with DuckDB oracles."""
