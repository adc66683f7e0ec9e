"""Operators for text and vector training data. Nothing else in the library imports this package."""
