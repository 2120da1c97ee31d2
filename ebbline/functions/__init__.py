"""Column expressions and column-role constants."""
