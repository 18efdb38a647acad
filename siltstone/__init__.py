"""siltstone: a PySpark-native engine for documentation corpora and retrieval."""
