"""Sources of the trace-table engine."""
