"""Operators for preparing text and token collections; nothing else in the library imports this package."""
