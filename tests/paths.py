"""Folders of the given tables."""

SMALL_DIR = "/root/testdata/sf0.001"
