"""Training-data operators: dedup, filters, token counts, mixing. Nothing else in the library imports this package."""
