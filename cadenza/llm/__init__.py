"""Training-data operators: dedup, archives, filters, mixing, search, packing, sharding."""
