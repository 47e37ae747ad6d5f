"""Operators for preparing training data: sharding, deduplication, filters, mixing and token output.

Nothing outside this subpackage imports it.
"""
