"""Reading-corpus analytics on Spark."""
