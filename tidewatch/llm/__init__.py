"""Operators for text and model corpora; nothing else in the package imports this."""
