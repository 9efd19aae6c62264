"""Operators for large text corpora: filtering, de-duplication, search, sharding, mixing, packing."""
