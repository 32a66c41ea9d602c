"""Operators for preparing training data (texts, vectors, conversations).

Nothing else in the library imports this subpackage.
"""
