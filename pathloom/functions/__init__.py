"""Column functions and small statistics."""
