"""Operators for preparing text corpora: cleaning, deduplication, scoring, tokens, mixing and sharding."""
