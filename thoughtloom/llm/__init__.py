"""Training-data operators: quality, de-duplication, mixing, tokenising, scoring."""
