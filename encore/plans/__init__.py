"""Plans of the performance-log engine."""
