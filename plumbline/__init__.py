"""Leakage-aware dataset preparation and evaluation on Spark."""
