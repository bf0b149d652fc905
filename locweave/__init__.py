"""Spark-native analytics over large inventories of URLs."""
