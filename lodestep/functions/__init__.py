"""Column functions: row patterns, names, and text."""
