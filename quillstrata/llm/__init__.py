"""Training-data operators: filters, deduplication, mixing, search and tokenizing over whole corpora."""
