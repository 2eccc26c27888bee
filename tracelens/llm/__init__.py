"""Operators for training-data pipelines: deduplication, filtering, tokenising, packing.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
registered queries; each other module holds one operator.
"""
