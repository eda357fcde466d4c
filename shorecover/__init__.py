"""Coverage analytics for aerial surveys as Spark jobs."""
