"""Column functions: comparisons, bits, fixed point, piecewise polynomials."""
