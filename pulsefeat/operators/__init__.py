"""Feature families, fit and transform, validation, quality audit, splits, plot data."""
