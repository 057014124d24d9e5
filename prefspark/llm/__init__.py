"""Operators for preparing training data: scanning, filtering, deduplication, mixing, search, encoding and archives."""
