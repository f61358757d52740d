"""A Spark-native engine for versioned cell tables, secondary access paths and aggregates."""
