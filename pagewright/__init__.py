"""Spark-native document engine: OCR post-processing and large text corpora."""
