"""Loading raw files as they arrive."""
