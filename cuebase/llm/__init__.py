"""Training-data operators: deduplication, filtering, mixing and sharding of a text corpus."""
