"""Training-data operators: quality, near-duplicates, archives, packing, tokens, language, search."""
