"""The query catalogue: each registered query is a Spark plan plus, where SQL can
express it, the DuckDB oracle SQL used to check it."""
