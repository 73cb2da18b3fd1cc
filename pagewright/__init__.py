"""pagewright: a Spark-native engine that turns crawled pages into clean, comparable records."""
