"""lodestone: a Spark-native engine for typed, versioned tables."""
