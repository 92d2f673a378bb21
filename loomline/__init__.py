"""Loomline: linked-structure, time-series and corpus analytics as PySpark DataFrame jobs."""
