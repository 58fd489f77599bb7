"""Operators of the performance-log engine."""
