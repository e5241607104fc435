"""Column expressions: normalisation, parsing, comparison."""
