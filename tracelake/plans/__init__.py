"""Plans of the trace-table engine."""
