"""Spark-native analytics for web content: extraction scoring, change history, links, prices, quality and retrieval."""
