"""Logical tables and registered queries."""
