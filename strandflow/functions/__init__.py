"""Scalar functions of the language, by name."""
