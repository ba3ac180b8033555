"""Spark-native engine for curating and evaluating code-reasoning corpora."""
