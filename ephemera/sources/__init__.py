"""Readers of navigation products and error tables, and writers of results."""
