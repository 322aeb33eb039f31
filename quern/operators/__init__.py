"""Relational operators that compose built-in ones where the plain form would not scale."""
