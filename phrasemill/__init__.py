"""A Spark-native engine for dense phrase retrieval and the data work around it."""
