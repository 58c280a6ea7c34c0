"""grovekit: a PySpark-native engine for detection, entity-linking and training-data tables."""

__version__ = "0.1.0"
