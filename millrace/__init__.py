"""millrace: a Spark-native engine for curating parallel text corpora."""
