"""Column expressions: local time, periods, rounding, identifiers."""
