"""locusframe: a Spark-native engine for association summary statistics."""
