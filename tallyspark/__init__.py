"""Spark-native analytics over captured AI spend and accepted engineering work."""
