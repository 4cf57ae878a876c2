"""Training-data operators: deduplication, scoring, filtering, tokens, extraction."""
