"""Training-data operators: cleaning, deduplicating, scoring, mixing and sharding text corpora."""
