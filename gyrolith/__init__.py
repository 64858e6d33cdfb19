"""Spark-native analytics for ordered sensor series and the text that travels with them."""

__version__ = "0.1.0"
