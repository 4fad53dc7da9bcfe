"""Column functions: colour."""
