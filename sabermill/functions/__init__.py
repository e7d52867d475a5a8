"""Column functions: odds arithmetic, rounding, bins, text, probability transforms."""
