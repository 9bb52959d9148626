"""embervane: a PySpark-native engine for evaluating frozen representations at scale."""

__version__ = "0.1.0"
