"""Operators of a training-data pipeline: counting, filtering, deduplicating and encoding documents."""
