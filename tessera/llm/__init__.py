"""Operators for training-data pipelines: token counts, sampling, quality,
de-duplication, sharding, packing, secret scans and media columns.

Nothing else in the library imports this subpackage.
"""
