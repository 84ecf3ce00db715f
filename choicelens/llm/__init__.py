"""Operators for preparing training corpora: search, sharding, filtering, deduplication, mixing and output."""
