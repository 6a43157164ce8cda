"""Column functions and generators on sequences and segments."""
