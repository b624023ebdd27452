"""Column expressions: keys, predicates and cell arithmetic."""
