"""Column expressions: geometry, vectors and text."""
