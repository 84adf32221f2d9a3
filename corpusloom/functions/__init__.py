"""Column-level functions (scalar expressions, vector helpers, Arrow UDFs)."""
