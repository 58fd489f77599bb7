"""Sources of the performance-log engine."""
