"""Operators for preparing training data: joins, filters, dedup, tokenizers, search and extraction."""
