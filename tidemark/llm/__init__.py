"""Operators for large training-data pipelines: quality, privacy, language,
mixing, token counts, decontamination, sharding and deduplication.

Nothing else in the package imports this subpackage.
"""
