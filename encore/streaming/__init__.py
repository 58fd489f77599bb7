"""Streaming of the performance-log engine."""
