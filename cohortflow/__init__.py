"""Cohort, signal-window and risk-score operators as lazy PySpark DataFrame functions."""

__version__ = "0.1.0"
