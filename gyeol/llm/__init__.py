"""Operators for preparing training data: splitting, statistics, repair, search, encoding, packing.

Nothing outside this subpackage imports it.
"""
