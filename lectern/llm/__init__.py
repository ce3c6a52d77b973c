"""Training-data operators: the ten dealt operators and what they share. Nothing else in the library imports this package."""
