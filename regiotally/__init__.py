"""Regional incident analytics as Spark DataFrame jobs."""
