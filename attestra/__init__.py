"""PySpark-native event verification and analytics."""
