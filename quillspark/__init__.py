"""Part of the metric-flow engine."""
