"""Literature search and text analytics on Spark."""
