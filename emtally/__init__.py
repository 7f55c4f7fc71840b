"""Abundance estimation from ambiguously mapped observations, as Spark jobs."""
