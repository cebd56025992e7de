"""The driver's tables in a weather shape, the registered queries on them, and their DuckDB counterparts."""
