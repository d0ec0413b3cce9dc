"""Operators for large-scale training-data preparation, each in a module of its own.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
