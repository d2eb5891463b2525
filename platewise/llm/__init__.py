"""Operators that prepare training text and vectors, one module each.

Nothing else in the library imports this package.
"""
