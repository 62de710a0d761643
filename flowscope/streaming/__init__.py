"""streaming of the flow-evidence engine."""
