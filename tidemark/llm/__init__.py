"""Operators for preparing training data: scoring, deduplication, search, mixing, packing and file output."""
