"""Column expressions of the fact model."""
