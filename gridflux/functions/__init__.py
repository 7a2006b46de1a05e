"""Column expressions: IEEE arithmetic, elementary and special functions, orthogonal polynomials, windows, derivatives."""
