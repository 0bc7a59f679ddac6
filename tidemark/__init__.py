"""Ordered-series analytics on Spark: segmentation, ranking, folds and review reports."""
