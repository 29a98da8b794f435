"""Change-stream analytics on Spark."""
