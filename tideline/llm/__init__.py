"""Operators for the text of a training corpus. Nothing outside imports this package."""
