"""Plan-shape helpers (size-checked per-client joins, salted top-k) and the
registry of named queries with their DuckDB oracle SQL."""
