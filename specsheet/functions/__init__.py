"""Column-level functions (pure Spark expressions) and aggregate helpers."""
