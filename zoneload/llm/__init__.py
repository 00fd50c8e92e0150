"""Corpus preparation at scale: deduplication, sharding, scoring, decontamination, search, packing."""
