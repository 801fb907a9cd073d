"""Column functions: text, classification, code and HTML."""
