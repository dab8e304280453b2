"""A Spark-native engine for analytics over code, text, history and event data."""
