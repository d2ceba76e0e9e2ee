"""tidemark: a Spark-native commerce lakehouse library."""
