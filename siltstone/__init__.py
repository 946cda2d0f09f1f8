"""siltstone: a Spark-native engine for indexing and exploring files, documents and vectors."""
