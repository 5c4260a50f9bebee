"""Operators for preparing training data: search, counts, language, dedup, sharding, packing, BPE, scoring."""
