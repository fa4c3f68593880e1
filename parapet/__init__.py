"""Message analytics on Spark."""
