"""attesta: a Spark-first trust engine for multi-source master data."""
