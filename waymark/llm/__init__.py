"""Operators for building training data: dedup, packing, tokens, quality, personal data and the like."""
