"""functions of the flow-evidence engine."""
