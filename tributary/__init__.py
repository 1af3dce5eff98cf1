"""PySpark-native analytics engine for multi-source customer and event data."""
