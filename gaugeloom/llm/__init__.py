"""Operators for large training-text tables. Nothing outside this subpackage imports it."""
