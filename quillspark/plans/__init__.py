"""Batch plans: building the index tables of a collection and querying them."""
