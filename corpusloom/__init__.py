"""Corpus consolidation as Spark DataFrame jobs."""
