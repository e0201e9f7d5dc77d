"""Operators for large training corpora: deduplication, packing, scoring, search and archives."""
