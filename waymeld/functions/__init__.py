"""Column functions: geometry, text, tags and modes."""
