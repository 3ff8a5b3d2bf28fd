"""Column functions and the fixed feature contract."""
