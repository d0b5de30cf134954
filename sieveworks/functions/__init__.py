"""Column expressions: text keys, tolerances and similarities."""
