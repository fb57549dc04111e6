"""Operators of a training-data pipeline: deduplication, search, counting, language, sharding, encoding and packing."""
