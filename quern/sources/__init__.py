"""Readers of files that hold rows."""
