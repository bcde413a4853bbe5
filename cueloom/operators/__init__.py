"""Relational operators that timed text needs beyond the built-in ones."""
