"""Prose rewriting and auditing at corpus scale, as PySpark jobs."""
