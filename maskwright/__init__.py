"""Spark-native privacy analytics: detect, tokenize, sanitize, audit and plan over placeholders."""
