"""Operators for preparing training data at scale: extraction, filtering, deduplication, search, mixing."""
