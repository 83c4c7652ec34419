"""A PySpark-native engine for reconciling bibliographic records."""
