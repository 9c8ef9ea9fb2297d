"""Column expressions: type codes, casts between them, orderings and key bounds."""
