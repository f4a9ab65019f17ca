"""Operators over tables: filters, aggregates, chunks, terms and retrieval."""
