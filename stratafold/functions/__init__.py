"""Estimators, intervals and decisions."""
