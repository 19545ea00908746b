"""derlem: Spark-native document retrieval, enrichment and corpus preparation."""
