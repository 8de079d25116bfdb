"""Corpus operators: near-dedup, language, filters, search, mixing, packing and sharding of training data."""
