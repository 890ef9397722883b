"""Spark-native engine for curating and evaluating labelled corpora of test code."""
