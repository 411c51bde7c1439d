"""Operators of a training-data pipeline: archives, filters, duplicates, mixing, tokens, search."""
