"""Training-data operators: deduplication, media, sharding, mixing, quality, URLs, encoding and chat layouts."""
