"""textloom: a PySpark-native engine for text corpora and event data."""
