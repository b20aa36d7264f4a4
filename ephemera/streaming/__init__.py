"""Structured Streaming over arriving daily files, with the batch expressions."""
