"""A PySpark-native engine for release feeds, catalog resolution and catalog analytics."""
