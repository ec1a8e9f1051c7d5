"""Operators of a training-data pipeline: deduplication, filtering, extraction, scoring and packing of documents."""
