"""Column functions: text, identity, vectors and string similarity."""
