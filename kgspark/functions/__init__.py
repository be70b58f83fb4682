"""Column functions and the relation vocabulary."""
