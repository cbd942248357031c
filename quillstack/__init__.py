"""Spark-native engine for web-content archives: discovery, extraction, validation, archives, updates and training text."""

__version__ = "0.1.0"
