"""Query registry: every query of the library with its DuckDB counterpart."""
