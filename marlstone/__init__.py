"""Spark-native research analytics: corpus catalogue, retrieval, graph, entities and text ETL."""
