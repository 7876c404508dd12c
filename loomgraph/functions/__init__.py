"""Column functions: text, vectors and hashes."""
