"""Training-data operators: dedup, tokenizing, classifiers, mixing, sharding, archives."""
