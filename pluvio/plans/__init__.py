"""Whole queries composed of operators, and their DuckDB twins."""
