"""Spark-native lexical document retrieval and text analytics."""
