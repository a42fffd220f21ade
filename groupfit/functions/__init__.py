"""Column expressions: number parsing, rounding, formatting, prediction."""
