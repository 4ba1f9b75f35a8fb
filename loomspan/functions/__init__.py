"""Column functions with Python's text semantics, for conversations, and for JSON."""
