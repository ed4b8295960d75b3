"""Readers and sinks of the pipeline's tables."""
