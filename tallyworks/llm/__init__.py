"""Training-data operators: packing, mixing, filtering, deduplication, scoring and sharding."""
