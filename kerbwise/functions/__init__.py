"""Column expressions: geometry, calendar, rules and rounding."""
