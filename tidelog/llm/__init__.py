"""Operators that prepare training data: deduplication, filtering, extraction, packing."""
