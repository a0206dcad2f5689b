"""Column expressions: every function here takes and returns Spark ``Column`` objects."""
