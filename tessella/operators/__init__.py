"""Operators over the property graph."""
