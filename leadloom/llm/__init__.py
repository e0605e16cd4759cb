"""Operators for building training data: tokens, search, language, quality, mixing, archives, near duplicates."""
