"""Column expressions and parameter tables that the operators share."""
