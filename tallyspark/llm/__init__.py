"""Training-data operators: token counts, packing, search, deduplication, rules, archives, scoring, extraction."""
