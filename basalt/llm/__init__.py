"""Training-data operators: packing, near-duplicate joins, token files, filters, mixing, sharding."""
