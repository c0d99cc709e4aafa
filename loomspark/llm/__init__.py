"""Training-data operators: filtering, extraction, deduplication and packing."""
