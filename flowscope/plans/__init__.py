"""plans of the flow-evidence engine."""
