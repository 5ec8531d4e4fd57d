"""Document-safety analytics on Spark."""
