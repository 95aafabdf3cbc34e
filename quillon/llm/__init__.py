"""Operators for preparing training data: deduplication, classifiers, mixing, tokens, archives and search."""
