"""A PySpark-native engine for curating large text corpora."""

__version__ = "0.1.0"
