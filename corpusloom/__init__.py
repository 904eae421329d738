"""A Spark-native document analytics and retrieval engine."""
