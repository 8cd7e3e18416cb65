"""A Spark-first engine for full-population journal-entry analytics."""
