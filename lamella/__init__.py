"""Spark-native analytics of multiplexed cell images."""
