"""Last-mile delivery analytics as Spark DataFrame, SQL and ML jobs."""
