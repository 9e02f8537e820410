"""A Spark-native engine for fielded, positional, ranked full-text search and text analytics."""
