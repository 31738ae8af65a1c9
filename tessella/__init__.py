"""Spark-native engine for analysing file collections, their content chunks and their change history as tables."""
