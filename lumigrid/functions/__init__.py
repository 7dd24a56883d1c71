"""Column expressions used by the operators.  Built-in functions only."""
