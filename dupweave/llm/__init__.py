"""Training-data operators: sharding, scans, near-duplicate joins, mixing, extraction and media."""
