"""Column expressions: sample levels, curves, lens polynomials, text and number rules."""
