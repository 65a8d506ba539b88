"""Column expressions and published residue tables."""
