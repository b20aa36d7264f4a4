"""Operators for cleaning, deduplicating, scoring and packing text corpora on Spark."""
