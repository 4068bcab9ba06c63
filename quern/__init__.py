"""C-source analytics and training-data operators on Spark."""
