"""Quern: a Spark-native engine for evaluating retrieval and ranking systems."""
