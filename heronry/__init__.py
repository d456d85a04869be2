"""Spark-native analytics: anomaly-detection evaluation and trajectory auditing on DataFrames."""
