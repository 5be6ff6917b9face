"""Column expressions and distributed statistics."""
