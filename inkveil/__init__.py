"""Spark-native detection, redaction and reversible tokenization of personal data in text."""
