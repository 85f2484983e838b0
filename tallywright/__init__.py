"""Planning-and-analysis engine expressed as Spark DataFrame jobs."""
