"""Operators for preparing training data: deduplication, filtering, scoring and packing of documents."""
