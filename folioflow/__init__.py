"""Spark-native document processing."""
