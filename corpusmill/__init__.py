"""A Spark-native engine that turns documents and rows into curated training datasets."""
