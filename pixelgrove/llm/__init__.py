"""Operators for building training data: deduplication, extraction, scans, filters and packing."""
