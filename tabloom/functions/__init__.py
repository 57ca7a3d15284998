"""Column functions: text, numbers and dates, hashing, identifiers."""
