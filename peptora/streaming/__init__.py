"""Operators over arriving records."""
