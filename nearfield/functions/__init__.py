"""Column expressions and fitted array functions."""
