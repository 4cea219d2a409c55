"""Column functions, by subject."""
