"""Operators for preparing training text at scale (packing, toxicity, quality,
dedup, language-model scores, tokenising, similarity join, vector search, token
files, personal data). Nothing outside this package imports it."""
