"""Operators that are larger than one expression."""
