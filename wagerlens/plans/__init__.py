"""The catalogue of operators by name."""
