"""Column expressions: patterns, normalisation, shapes."""
