"""Reading change logs and resolving raw tuples."""
