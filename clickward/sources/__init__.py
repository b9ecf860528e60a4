"""Readers, writers, generators and the adapters over the given tables."""
