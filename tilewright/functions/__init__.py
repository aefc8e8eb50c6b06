"""Column expressions and small aggregate building blocks."""
