"""Workforce analytics as PySpark DataFrame transformations."""
