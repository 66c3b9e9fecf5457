"""Skew-aware event analytics on PySpark."""
