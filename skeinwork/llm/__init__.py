"""Training-data operators: quality, deduplication, PII, packing, sharding and URL filtering over documents."""
