"""Spark-native labelled-text analytics: clean, chunk, score, balance, split, train, evaluate, converse."""

__version__ = "0.1.0"
