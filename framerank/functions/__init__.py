"""Column expressions: predicates, scores and pixel formulas."""
