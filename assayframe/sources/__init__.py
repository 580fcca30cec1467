"""Readers and writers: cells, wide and long matrices, metrics, summaries."""
