"""Evidence and operations analytics on Spark."""
