"""Functions of the prose audit library."""
