"""Column expressions and vectorised text extraction."""
