"""Operators for training-data corpora: archives, pages, duplicates, benchmarks, personal data, tokens, languages."""
