"""Functions of the performance-log engine."""
