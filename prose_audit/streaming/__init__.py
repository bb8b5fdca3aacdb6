"""Streaming of the prose audit library."""
