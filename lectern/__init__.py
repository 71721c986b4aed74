"""A PySpark-native engine for retrieval and content analytics over document collections."""
