"""Span-level personal-data engine on the PySpark DataFrame API."""
