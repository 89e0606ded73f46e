"""Reading, canonicalising and writing the tables."""
