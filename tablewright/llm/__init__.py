"""Training-data operators: dedup, mixing, filters, packing, search and classifiers."""
