"""Streaming of the trace-table engine."""
