"""Column functions and url parsing."""
