"""Operators that prepare training text: screening, deduplication, packing and record files."""
