"""Operators for training-data preparation: search, deduplication, personal data, tokens, languages and packing."""
