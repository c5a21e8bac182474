"""Operators for record linkage and training text. Nothing else in the library imports this subpackage."""
