"""A Spark-native phrase index and pattern-search engine."""
