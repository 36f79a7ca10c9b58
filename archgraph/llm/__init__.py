"""Operators of a training-data pipeline: extraction, quality, deduplication, tokens and packing.

Nothing outside this subpackage imports it.
"""
