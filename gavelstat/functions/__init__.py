"""Column expressions and small distributed primitives."""
