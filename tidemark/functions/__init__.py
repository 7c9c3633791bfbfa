"""Column expressions: type map, value encodings, JSON text."""
