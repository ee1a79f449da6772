"""A PySpark-native engine for paper-check intake and its analytics."""
