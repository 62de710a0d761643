"""Flow-evidence analytics on Spark."""
