"""Cohort selection, windowed features, audits and risk models on Spark DataFrames."""

__version__ = "0.1.0"
