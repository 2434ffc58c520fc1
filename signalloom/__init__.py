"""Point-in-time features, labels and selection over a corpus of works, on Spark."""
