"""Column functions and the rules that they follow."""
