"""Plans of the prose audit library."""
