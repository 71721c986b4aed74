"""Operators for building training data: cleaning, deduplication, mixing, packing and tokenising."""
