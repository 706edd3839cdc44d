"""Freight-invoice audit as PySpark DataFrame jobs."""
