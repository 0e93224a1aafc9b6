"""A PySpark-native engine for compressed binary data."""

__version__ = "0.1.0"
