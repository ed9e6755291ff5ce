"""Flight-track analytics and training-data operators as Spark DataFrame transforms."""
