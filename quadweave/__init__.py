"""A Spark-native engine for knowledge graphs over documents and tables."""
