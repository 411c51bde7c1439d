"""Structured Streaming jobs. The transformations are the batch ones wherever they can be."""
