"""Training-data operators: dedup, tokenising, packing, extraction, PII, language, search, quality."""
