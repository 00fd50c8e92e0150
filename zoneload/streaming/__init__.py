"""Metric series, in batches and as streams."""
