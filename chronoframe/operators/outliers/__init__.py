"""Anomaly detection in series."""
