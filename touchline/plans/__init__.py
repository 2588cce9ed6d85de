"""Skew-safe building blocks: ordered blocks, global ranks, quantiles, as-of windows."""
