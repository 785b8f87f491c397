"""Column functions with Python's rules for text."""
