"""Plans: the end-to-end run, the query catalog and its DuckDB oracle texts."""
