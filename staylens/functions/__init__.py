"""Column expressions: every function here takes and returns Spark columns."""
