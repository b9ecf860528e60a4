"""Operators for training corpora: deduplication, filters, scans, extraction and packing."""
