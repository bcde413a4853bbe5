"""Column functions: text, time codes, intervals and similarity."""
