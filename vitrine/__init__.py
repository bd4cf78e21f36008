"""Price-catalog analytics on Spark."""
