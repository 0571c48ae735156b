"""Structured Streaming twins of order-dependent operators."""
