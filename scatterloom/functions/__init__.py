"""Column expressions: vectors, element constants, reproducible random draws."""
