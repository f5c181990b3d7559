"""Rewrites of plans that the optimiser has no rule for."""
