"""PHP tokens and facts; plain Python without Spark."""
