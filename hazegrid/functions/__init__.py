"""Column expressions: no state, no actions, usable on any table."""
