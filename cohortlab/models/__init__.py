"""Splits, preparation, training, scoring, attribution and generalisation."""
