"""Spark-native de-identification of documents at corpus scale."""
