"""Column expressions and per-file functions."""
