"""Column-level building blocks (native Spark expressions)."""
