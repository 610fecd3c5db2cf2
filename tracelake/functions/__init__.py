"""Functions of the trace-table engine."""
