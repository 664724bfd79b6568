"""Column expressions: calendar, text clean-up, checks and bands."""
