"""Operators for training data: extraction, cleaning, deduplication, scoring, packing."""
