"""Column expressions: everything here is a built-in Catalyst expression."""
