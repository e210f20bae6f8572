"""Reading, cleaning, checking and writing the five tables."""
