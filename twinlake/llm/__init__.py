"""Training-data operators (media, tokens, language, packing, dedup, PII, search)."""
