"""Operators of the trace-table engine."""
