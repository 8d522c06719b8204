"""Operators for preparing training data: filtering, deduplication, scoring, encoding and packing."""
