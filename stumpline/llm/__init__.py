"""Operators of a training-data pipeline: tokens, duplicates, filters and packing."""
