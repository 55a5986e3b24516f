"""Column expressions: intervals, titles, similarity, identifiers, formats."""
