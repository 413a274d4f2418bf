"""Column expressions: rules and measures."""
