"""Plans: the pipeline and the registered queries (Spark side and SQL oracle side)."""
