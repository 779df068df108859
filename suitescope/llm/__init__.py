"""Operators for preparing training text: mixing, filtering, deduplication, scanning, counting.

Nothing else in the package imports this subpackage.
"""
