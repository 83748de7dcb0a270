"""Text retrieval, ranking and training-data preparation on Spark."""
