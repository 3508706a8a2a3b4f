"""Spark-native analytics over structured texts and the citation graphs inside them."""
