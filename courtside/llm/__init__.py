"""Operators for large text corpora: search, de-duplication, filters, mixing, tokenizers, scoring."""
