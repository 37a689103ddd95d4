"""Spark-native text-quality analytics: spelling and notation checks as lazy DataFrame plans."""

__version__ = "0.1.0"
