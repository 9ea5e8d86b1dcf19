"""Synthetic experiments with known truth, and scenarios that catch wrong analyses."""
