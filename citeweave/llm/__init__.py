"""Operators of a training-data pipeline: tokenising, sharding, deduplication,
classification, secret scanning, packing, URL filtering and media columns.

Nothing else in the library imports this subpackage.
"""
