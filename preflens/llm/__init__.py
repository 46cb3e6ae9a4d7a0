"""Operators for preparing training data: filters, tokens, duplicates, packing, extraction."""
