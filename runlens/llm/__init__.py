"""Corpus preparation: deduplication, search, classification, tokenizing and mixing."""
