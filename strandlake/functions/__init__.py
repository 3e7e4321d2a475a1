"""Column expressions and small value types."""
