"""Sources of the prose audit library."""
