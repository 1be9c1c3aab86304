"""Mobile element insertions on Spark, and operators for training data."""
