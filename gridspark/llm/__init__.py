"""Operators for building text training corpora (nothing else in the library imports this package)."""
