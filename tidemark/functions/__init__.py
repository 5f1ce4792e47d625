"""Column expressions: normalisation, literals, positions, classifiers."""
