"""Operators for large training corpora: packing, deduplication, filtering, scoring, sharding."""
