"""Code graphs and training-data operators on Spark."""
