"""A PySpark-native analytics engine for conversational and knowledge-base data."""

__version__ = "0.1.0"
