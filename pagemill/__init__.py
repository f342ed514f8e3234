"""Spark-native site auditing and text processing."""
