"""Column functions and fixed rule tables."""
