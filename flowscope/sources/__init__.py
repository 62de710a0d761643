"""sources of the flow-evidence engine."""
