"""Scalar functions as column expressions, and the registry of extensions."""
