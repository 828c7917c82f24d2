"""Column expressions: vectors and codecs."""
