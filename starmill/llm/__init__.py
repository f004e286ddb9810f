"""Operators for preparing training text: filters, archives, near-duplicates, quality, mixing."""
