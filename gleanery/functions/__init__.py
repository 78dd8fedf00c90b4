"""Column functions: everything here is a composition of built-in expressions."""
