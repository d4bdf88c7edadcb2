"""Training-data operators: mixing, tokens, toxicity, dedup, extraction, quality, WARC."""
