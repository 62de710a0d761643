"""operators of the flow-evidence engine."""
