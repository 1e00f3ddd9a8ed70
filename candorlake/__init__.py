"""Review-integrity analytics and training-corpus preparation on Spark."""
