"""Operators of the prose audit library."""
