"""Training-data operators: quality, tokenising, sharding, search, packing, toxicity, deduplication, URL filters, language models."""
