"""Hazard-report analytics as PySpark DataFrame functions."""
