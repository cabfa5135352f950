"""Column functions: urls, text."""
