"""Note-vault analytics on Spark."""
