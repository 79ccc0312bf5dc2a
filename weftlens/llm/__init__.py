"""Training-data operators: scoring, scanning, sharding, packing and deduplication of document tables."""
