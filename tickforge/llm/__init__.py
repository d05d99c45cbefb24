"""Operators for preparing training text, each an ordinary DataFrame function."""
