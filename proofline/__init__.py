"""Evidence-preserving record analytics on Spark."""
