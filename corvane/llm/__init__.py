"""Training-data operators: tokenising, mixing, deduplication, filtering and scoring at corpus scale."""
