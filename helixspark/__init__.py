"""A PySpark-native engine for biological sequence data and text corpora."""

__version__ = "0.1.0"
