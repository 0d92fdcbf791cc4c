"""Training-data operators: formatting, cleaning, deduplication, tokenising, packing and layout."""
